"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import dates
from ledgerlake.operators.match import small


def live() -> Column:
    """Live spend: not internal, not ruled invalid."""
    return (F.col("internal_provider") == 0) & (F.col("validation_status").isNull() | (F.col("validation_status") != "invalid"))


def named() -> Column:
    return F.col("supplier_canon").isNotNull() & (F.col("supplier_canon") != "")


def in_fy(fy: int, by: str = "paid_date") -> Column:
    """Financial year by paid date (inclusive) or by period."""
    if by == "period":
        return F.col("period").between(f"{fy}-04", f"{fy + 1}-03")
    return F.col(by).between(F.lit(f"{fy}-04-01").cast("date"), F.lit(f"{fy + 1}-03-31").cast("date"))


def organisations(config: DataFrame, *, types: list[str] | None = None, region: str | None = None, nation: str | None = None, authority: str | None = None, contains: str | None = None, strategic: bool = False) -> DataFrame:
    """Organisations by attributes; strategic authorities only on request."""
    out = config if strategic else config.where(F.col("council_type") != "Strategic Authority")
    for value, test in ((types, lambda v: F.col("council_type").isin(v)), (region, lambda v: F.col("region") == v), (nation, lambda v: F.left("lad_code", F.lit(1)) == v), (authority, lambda v: F.col("combined_authority") == v), (contains, lambda v: F.lower("council").contains(v.lower()))):
        out = out.where(test(value)) if value else out
    return out


def without_devolved(df: DataFrame, config: DataFrame) -> DataFrame:
    """Payments but those of devolved governments; area codes that no organisation has drop too."""
    attrs = config.select(F.col("lad_code").alias("_lad"), F.col("council_type").alias("_type"), F.col("region").alias("_region"))
    devolved = (F.col("_type") == "Strategic Authority") & F.col("_region").isin("Scotland", "Wales", "Northern Ireland")
    return df.join(attrs, F.col("lad_code") == F.col("_lad"), "left").where(~devolved).drop("_lad", "_type", "_region")


def category_gate(gate: Column, category: Column) -> Column:
    """Comma list: a token of up to four characters has to equal the category, a longer one has to be in it.  No gate lets all pass."""
    tokens = F.filter(F.transform(F.split(F.lower(gate), ","), lambda t: F.trim(t)), lambda t: t != "")
    low = F.lower(F.trim(category))
    hit = F.exists(tokens, lambda t: F.when(F.char_length(t) <= 4, low == t).otherwise(low.contains(t)))
    return gate.isNull() | (F.trim(gate) == "") | F.coalesce(hit, F.lit(False))


def era(floor: str = "2022-01-01", late_floor: str = "2022-04-01", late: Column | None = None) -> Column:
    """Dates before the floor drop; flagged sources have a later one.  A missing date stays."""
    day = F.when(F.coalesce(late, F.lit(False)) if late is not None else F.lit(False), F.lit(late_floor)).otherwise(F.lit(floor)).cast("date")
    return F.col("paid_date").isNull() | (F.col("paid_date") >= day)


def period_of_shared_files(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of files that serve several periods stay in the source of their own month only; a missing date drops there."""
    shared = sources.groupBy("url").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("url").alias("_url"))
    out = rows.join(sources.select("source_id", "url", F.col("period").alias("_period")), "source_id").join(shared, F.col("url") == F.col("_url"), "left")
    return out.where(F.col("_url").isNull() | (F.date_format("paid_date", "yyyy-MM") == F.col("_period"))).drop("_url", "_period")


def local_government(buyer: Column) -> Column:
    return buyer.rlike(r"(?i)council|combined authority|borough|county|metropolitan")


def keywords(query: str, columns: list[str]) -> Column:
    """Three characters or more: the first word whole, the last as a prefix, in any column; less: contained."""
    words = query.lower().split()
    text = F.lower(F.concat_ws(" ", *columns))
    if len(query) < 3 or not words:
        return text.contains(query.lower())
    first = text.rlike(rf"\b{_quoted(words[0])}\b") if len(words) > 1 else F.lit(True)
    return first & text.rlike(rf"\b{_quoted(words[-1])}")


def _quoted(word: str) -> str:
    import re

    return re.escape(word)


def tender_state(as_of: Column) -> Column:
    """open, pipeline, or NULL."""
    open_ = (F.col("status") == "active") & (F.col("tender_end_date").isNull() | (F.col("tender_end_date") >= as_of))
    return F.when(open_, "open").when(F.col("status").isin("planned", "planning"), "pipeline")


def expire(notices: DataFrame, as_of: Column) -> DataFrame:
    """Active notices past their deadline become complete."""
    over = (F.col("status") == "active") & (F.col("tender_end_date") < as_of)
    return notices.withColumn("status", F.when(over, "complete").otherwise(F.col("status")))


def expiring(entries: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    return entries.where((F.col("is_tech") == 1) & F.col("end_date").between(as_of, F.add_months(as_of, months)))


def expired(entries: DataFrame, as_of: Column, months: int = 3) -> DataFrame:
    return entries.where((F.col("is_tech") == 1) & (F.col("end_date") >= F.add_months(as_of, -months)) & (F.col("end_date") < as_of))


def awarded(after: str | None = None, before: str | None = None) -> Column:
    """F16: contracts that start on or after, and on or before, these days; with either, one without a start drops."""
    out = F.lit(True)
    out = out & (F.col("start_date") >= F.lit(after).cast("date")) if after else out
    return out & (F.col("start_date") <= F.lit(before).cast("date")) if before else out


def fy_label(by: str) -> Column:
    return dates.fy_from_period(F.col(by)) if by == "period" else dates.fy_from_date(F.col(by))


def entity_scope(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """of files that serve several bodies, the rows of each body's own: ``scope_values`` ('a|b', equal, any case) or ``name_contains``.

    ``catalogue``: source_id, scope_values, name_contains; both NULL let all rows pass.
    """
    c = catalogue.select(F.col("source_id").alias("_id"), F.transform(F.split(F.lower("scope_values"), r"\|"), lambda v: F.trim(v)).alias("_values"), F.lower("name_contains").alias("_part"))
    who = F.lower(F.trim("entity"))
    fits = F.when(F.col("_values").isNotNull(), F.array_contains("_values", who)).when(F.col("_part").isNotNull(), who.contains(F.col("_part"))).otherwise(F.lit(True))
    return rows.join(small(c), F.col("source_id") == F.col("_id")).where(F.coalesce(fits, F.lit(False))).drop("_id", "_values", "_part")


#: Texts that stand where a register's supplier should.
NOT_NAMES = ("supplier", "supplier name", "company", "company name", "n/a", "cell content exceeds data limits")


def plausible_name(name: Column) -> Column:
    """two characters or more, no header echo."""
    low = F.lower(F.trim(name))
    return F.coalesce((F.char_length(low) >= 2) & ~low.isin(*NOT_NAMES), F.lit(False))


def notice_filter(*, status: str | None = None, stage: str | None = None, cpv: str | None = None, source: str | None = None, buyer: str | None = None, classified: bool | None = None) -> Column:
    """any of status, stage, CPV division, source, buyer name part, classified or not."""
    out = F.lit(True)
    for column, value in (("status", status), ("stage", stage), ("cpv_division", cpv), ("source", source)):
        out = out & (F.col(column) == value) if value else out
    out = out & F.lower("buyer_name").contains(buyer.lower()) if buyer else out
    return out & (F.col("layer").isNotNull() == F.lit(classified)) if classified is not None else out


def sample_per_group(rows: DataFrame, group: list[str], key: list[str], n: int, seed: int = 1) -> DataFrame:
    """L3: ``n`` rows of each group, by a seeded hash of their key, so a rerun draws the same."""
    from pyspark.sql import Window

    draw = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *key).cast("binary")), *key)
    return rows.withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") <= n).drop("_draw")
