"""Spend summaries.  One grouping each, partial sums before the shuffle; distinct counts are exact."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions import dates
from ledgerlake.operators import filters

Shares = dict[str, dict[str, float]]


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("double")


def share_table(df: DataFrame, shares: Shares, key: str) -> DataFrame:
    """The joint bodies' shares as rows (council, key, share): a parameter, a few rows."""
    rows = [(name, lad, Decimal(str(s))) for name, parts in shares.items() for lad, s in parts.items()]
    return df.sparkSession.createDataFrame(rows, f"_body string, {key} string, _share decimal(6,4)")


def supplier_summary(spend: DataFrame, entries: DataFrame) -> DataFrame:
    """A1: per supplier, live spend and tech contracts."""
    paid = spend.where(filters.live() & filters.named()).groupBy("supplier_canon").agg(F.count_distinct("council").alias("council_count"), F.count("*").alias("payment_count"), money(F.sum("amount")).alias("total_spend"))
    held = entries.where("is_tech = 1").groupBy("supplier_canon").agg(F.count("*").alias("contract_count"), money(F.sum("value_amount")).alias("contract_value"))
    return paid.join(held, "supplier_canon", "left").na.fill(0, ["contract_count"]).na.fill(0.0, ["contract_value"])


def supplier_fy(spend: DataFrame) -> DataFrame:
    """A2: per supplier and financial year of the paid date."""
    return spend.where(filters.live() & filters.named() & F.col("paid_date").isNotNull()).groupBy("supplier_canon", filters.fy_label("paid_date").alias("fy")).agg(F.count_distinct("council").alias("council_count"), F.count("*").alias("payment_count"), money(F.sum("amount")).alias("total_spend"))


def _joint(rows: DataFrame, shares: Shares, keys: list[str]) -> DataFrame:
    """Rows of joint bodies (council, keys, total, payments, ...) handed to their areas: total x share, payments rounded."""
    return rows.join(F.broadcast(share_table(rows, shares, "lad_code")), F.col("council") == F.col("_body")).select("lad_code", *keys, (F.col("total") * F.col("_share")).alias("total"), F.round(F.col("payments") * F.col("_share")).cast("long").alias("payments"), *(c for c in rows.columns if c == "suppliers"))


def council_fy(spend: DataFrame, shares: Shares) -> DataFrame:
    """A3 + A6: per area and financial year of the period; joint bodies added to their areas, their supplier counts too."""
    rows = spend.where(filters.live()).withColumn("fy", filters.fy_label("period"))
    measures = [F.sum("amount").cast("decimal(18,2)").alias("total"), F.count("*").alias("payments"), F.count_distinct("supplier_canon").alias("suppliers")]
    own = rows.where(F.col("lad_code").isNotNull() & (F.col("lad_code") != "")).groupBy("lad_code", "fy").agg(*measures)
    bodies = rows.where(F.col("council").isin(list(shares))).groupBy("council", "fy").agg(*measures)
    both = own.select("lad_code", "fy", "total", "payments", "suppliers").unionByName(_joint(bodies, shares, ["fy"]))
    return both.groupBy("lad_code", "fy").agg(F.sum("total").cast("double").alias("total_spend"), F.sum("payments").alias("payment_count"), F.sum("suppliers").alias("supplier_count"))


def council_summary(spend: DataFrame, shares: Shares) -> DataFrame:
    """A5 + A6: per area; a joint body without rows adds none."""
    rows = spend.where(filters.live())
    measures = [F.sum("amount").cast("decimal(18,2)").alias("total"), F.count("*").alias("payments")]
    own = rows.where(F.col("lad_code").isNotNull() & (F.col("lad_code") != "")).groupBy("lad_code").agg(*measures)
    bodies = rows.where(F.col("council").isin(list(shares))).groupBy("council").agg(*measures)
    both = own.unionByName(_joint(bodies, shares, []))
    return both.groupBy("lad_code").agg(F.sum("total").cast("double").alias("total_spend"), F.sum("payments").alias("payment_count"))


def supplier_nation_fy(spend: DataFrame, config: DataFrame, shares: Shares) -> DataFrame:
    """A4 + A6: per supplier, financial year and nation, with '' for all nations; distinct councils are counted anew for ''.

    Devolved governments are left out.  Nation rows need an area code, '' rows don't.
    Joint bodies' payments are added to the nations of their areas by share, not
    to the rows of all nations; they count as a council only where a nation has no other.
    """
    rows = filters.without_devolved(spend.where(filters.live() & filters.named()), config)
    rows = rows.withColumn("fy", filters.fy_label("period")).withColumn("nation", F.left("lad_code", F.lit(1)))
    sets = rows.groupingSets([["supplier_canon", "fy", "nation"], ["supplier_canon", "fy"]], "supplier_canon", "fy", "nation")
    out = sets.agg(F.grouping("nation").alias("_all"), F.count_distinct("council").alias("council_count"), F.count("*").alias("payment_count"), money(F.sum("amount")).alias("total_spend"))
    out = out.where((F.col("_all") == 1) | (F.col("nation") != ""))
    out = out.withColumn("nation", F.when(F.col("_all") == 1, "").otherwise(F.col("nation"))).drop("_all")
    joint = spend.where(filters.live() & filters.named() & F.col("council").isin(*shares)).groupBy("council", "supplier_canon", filters.fy_label("period").alias("fy")).agg(F.count("*").alias("payments"), F.sum("amount").cast("decimal(18,2)").alias("total"))
    shared = _joint(joint, shares, ["supplier_canon", "fy"]).groupBy("supplier_canon", "fy", F.left("lad_code", F.lit(1)).alias("nation"))
    shared = shared.agg(F.lit(None).cast("long").alias("council_count"), F.sum("payments").alias("payment_count"), F.sum("total").cast("double").alias("total_spend"))
    both = out.unionByName(shared).groupBy("supplier_canon", "fy", "nation")
    return both.agg(F.coalesce(F.max("council_count"), F.lit(1).cast("long")).alias("council_count"), F.sum("payment_count").alias("payment_count"), F.sum("total_spend").alias("total_spend"))


def display_rows(spend: DataFrame, shares: Shares, areas: DataFrame) -> DataFrame:
    """Joint rows replaced by a row for each target area with its part of the amount; all others as they are."""
    parts = share_table(spend, shares, "_lad").join(areas.select(F.col("lad_code").alias("_lad"), F.col("council").alias("_council")), "_lad")
    out = spend.join(F.broadcast(parts), F.col("council") == F.col("_body"), "left")
    split = F.col("_lad").isNotNull()
    return out.withColumn("amount", F.when(split, (F.col("amount") * F.col("_share")).cast("decimal(18,6)")).otherwise(F.col("amount").cast("decimal(18,6)"))).withColumn("council", F.coalesce("_council", "council")).withColumn("lad_code", F.coalesce("_lad", "lad_code")).drop("_lad", "_council", "_body", "_share")


def overview(spend: DataFrame, config: DataFrame) -> DataFrame:
    """Per council, with its attributes and spend per head."""
    agg = spend.where(filters.live()).groupBy("council").agg(money(F.sum("amount")).alias("total"), F.count("*").alias("payments"), F.count_distinct("supplier_canon").alias("suppliers"), F.round(money(F.sum("amount")) / F.count("*"), 2).alias("average"), money(F.max("amount")).alias("largest"), F.min("paid_date").alias("first_date"), F.max("paid_date").alias("last_date"))
    attrs = config.select("council", "council_type", "region", "population")
    return agg.join(attrs, "council", "left").withColumn("per_head", F.round(F.col("total") / F.col("population"), 4)).drop("population")


def folded_overview(spend: DataFrame, shares: Shares, areas: DataFrame) -> DataFrame:
    """Council totals with joint bodies folded into their targets: sums shared, largest is the larger of own and shared, averages made anew, supplier counts as they are."""
    agg = spend.where(filters.live()).groupBy("council").agg(F.sum("amount").cast("decimal(18,2)").alias("total"), F.count("*").alias("payments"), F.max("amount").alias("largest"), F.min("paid_date").alias("first_date"), F.max("paid_date").alias("last_date"), F.count_distinct("supplier_canon").alias("suppliers"))
    parts = share_table(spend, shares, "_lad").join(areas.select(F.col("lad_code").alias("_lad"), F.col("council").alias("_council")), "_lad")
    joint = agg.join(F.broadcast(parts), F.col("council") == F.col("_body")).select(F.col("_council").alias("council"), (F.col("total") * F.col("_share")).alias("total"), F.round(F.col("payments") * F.col("_share")).cast("long").alias("payments"), (F.col("largest") * F.col("_share")).alias("largest"), "first_date", "last_date", F.lit(0).cast("long").alias("suppliers"))
    both = agg.where(~F.col("council").isin(list(shares))).unionByName(joint)
    out = both.groupBy("council").agg(F.sum("total").cast("double").alias("total"), F.sum("payments").alias("payments"), F.max("largest").cast("double").alias("largest"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.sum("suppliers").alias("suppliers"))
    return out.withColumn("average", F.round(F.col("total") / F.col("payments"), 2))


def kpis(spend: DataFrame) -> DataFrame:
    """A10."""
    return spend.where(filters.live()).agg(F.count("*").alias("payments"), F.count_distinct("supplier_canon").alias("suppliers"), F.count_distinct("council").alias("councils"), money(F.sum("amount")).alias("total"))


def top_suppliers(spend: DataFrame, page: int = 0, size: int = 40) -> DataFrame:
    """A page of suppliers by spend."""
    agg = spend.where(filters.live() & filters.named()).groupBy("supplier_canon").agg(money(F.sum("amount")).alias("total"), F.count("*").alias("payments"), F.count_distinct("council").alias("councils"), F.max("paid_date").alias("last_payment"))
    return agg.orderBy(F.desc("total"), "supplier_canon").offset(page * size).limit(size)


def supplier_authorities(spend: DataFrame, config: DataFrame) -> DataFrame:
    """The distinct authorities of each supplier, as one sorted list."""
    pairs = spend.where(filters.live() & filters.named()).select("supplier_canon", "council").distinct().join(config.select("council", "combined_authority"), "council")
    return pairs.groupBy("supplier_canon").agg(F.array_join(F.array_sort(F.collect_set("combined_authority")), ", ").alias("authorities"))


def totals_by_organisation(spend: DataFrame, ca_spend: DataFrame) -> DataFrame:
    """A12 + U1: both fact tables, marked."""
    councils = spend.where(filters.live()).groupBy("council").agg(money(F.sum("amount")).alias("total"), F.count("*").alias("payments")).select(F.col("council").alias("organisation"), "total", "payments", F.lit(0).alias("is_ca"))
    bodies = ca_spend.groupBy("ca_name").agg(money(F.sum("amount")).alias("total"), F.count("*").alias("payments")).select(F.col("ca_name").alias("organisation"), "total", "payments", F.lit(1).alias("is_ca"))
    return councils.unionByName(bodies)


def authority_groups(spend: DataFrame, ca_spend: DataFrame, config: DataFrame) -> DataFrame:
    """Per authority, the member councils' totals and the body's own."""
    members = spend.where(filters.live()).groupBy("council").agg(F.sum("amount").alias("t")).join(config.select("council", "combined_authority"), "council").groupBy("combined_authority").agg(F.count("*").alias("councils"), money(F.sum("t")).alias("member_total"))
    own = ca_spend.groupBy("ca_name").agg(money(F.sum("amount")).alias("own_total"))
    return members.join(own, F.col("combined_authority") == F.col("ca_name"), "left").drop("ca_name").na.fill(0.0, ["own_total"])


def nation_page(config: DataFrame, summary: DataFrame) -> DataFrame:
    """Per nation, region and authority: councils, spend and payments; councils without payments count."""
    s = summary.select(F.col("lad_code").alias("_lad"), "total_spend", "payment_count")
    return config.where("lad_code <> ''").join(s, F.col("lad_code") == F.col("_lad"), "left").groupBy(F.left("lad_code", F.lit(1)).alias("nation"), "region", "combined_authority").agg(F.count("*").alias("councils"), F.round(F.coalesce(F.sum("total_spend"), F.lit(0.0)), 3).alias("total"), F.coalesce(F.sum("payment_count"), F.lit(0)).cast("long").alias("payments"))


def monthly_trend(spend: DataFrame, first: str, last: str, keys: list[str] | None = None) -> DataFrame:
    """Every month from first to last, zero where nothing was paid, for each key that has any."""
    keys = keys or []
    agg = spend.where(filters.live()).groupBy(*keys, "period").agg(F.sum("amount").alias("_t"), F.count("*").alias("_n"))
    spine = spend.sparkSession.range(1).select(F.explode(F.sequence(F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("period"))
    if keys:
        spine = agg.select(*keys).distinct().withColumn("_m", F.array(*(F.lit(r) for r in _months(first, last)))).select(*keys, F.explode("_m").alias("period"))
    return spine.join(agg, [*keys, "period"], "left").select(*keys, "period", F.coalesce(money(F.col("_t")), F.lit(0.0)).alias("total"), F.coalesce("_n", F.lit(0)).cast("long").alias("payments"))


def _months(first: str, last: str) -> list[str]:
    a, b = (int(x[:4]) * 12 + int(x[5:]) - 1 for x in (first, last))
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(a, b + 1)]


def payment_profile(spend: DataFrame) -> DataFrame:
    """Per area."""
    return spend.where(filters.live()).groupBy("lad_code").agg(F.count("*").alias("payments"), F.count_distinct("supplier_canon").alias("suppliers"), money(F.sum("amount")).alias("total"), F.min("paid_date").alias("first_date"), F.max("paid_date").alias("last_date"), F.count_distinct("period").alias("periods"))


def supplier_by_council(spend: DataFrame, config: DataFrame) -> DataFrame:
    """Supplier and council, without devolved governments."""
    rows = filters.without_devolved(spend.where(filters.live() & filters.named()), config)
    agg = rows.groupBy("supplier_canon", "council").agg(money(F.sum("amount")).alias("total"), F.count("*").alias("payments"))
    return agg.join(config.select("council", "council_type", "region"), "council")


def coverage(spend: DataFrame, sources: DataFrame, config: DataFrame, first: str, last: str) -> DataFrame:
    """A18 + U2: months with payments or confirmed empty, out of all council months, in per cent."""
    held = spend.where(filters.live()).select("council", "period")
    empty = sources.where("active = 1 AND last_count = 0").select("council", "period")
    keys = held.unionByName(empty).where(F.col("period").between(first, last)).distinct().agg(F.count("*").alias("held"))
    months = len(_months(first, last))
    return config.agg(F.count("*").alias("councils")).crossJoin(keys).select("held", (F.col("councils") * months).alias("possible"), F.round(100 * F.col("held") / (F.col("councils") * months), 1).alias("percent"))


def completeness(spend: DataFrame, sources: DataFrame, cut_off: str) -> DataFrame:
    """A19 + U3: per council, the registered periods, those held or confirmed empty, and the missing ones in order."""
    registered = sources.where(F.col("period") <= cut_off).groupBy("council", "period").agg(F.max(F.coalesce((F.col("last_count") == 0).cast("int"), F.lit(0))).alias("empty"))
    held = spend.select("council", "period").distinct().withColumn("held", F.lit(1))
    both = registered.join(held, ["council", "period"], "left").withColumn("ok", F.greatest(F.coalesce("held", F.lit(0)), F.col("empty")))
    return both.groupBy("council").agg(F.count("*").alias("registered"), F.sum("ok").alias("have"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok") == 0, F.col("period")))), ",").alias("missing"), (F.min("ok") == 1).alias("complete"))


def date_span(spend: DataFrame) -> DataFrame:
    """Internal rows excluded only."""
    return spend.where("internal_provider = 0").groupBy("council").agg(F.min("paid_date").alias("first_date"), F.max("paid_date").alias("last_date"), money(F.sum("amount")).alias("total"))


def validation_counts(spend: DataFrame) -> DataFrame:
    """A21."""
    return spend.groupBy("council", F.coalesce("validation_status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def fingerprints(spend: DataFrame, columns: list[str]) -> DataFrame:
    """Per council and period: rows, sum, and the sum of the rows' CRC32, so that duplicates count."""
    from ledgerlake.functions.geo import row_crc

    return spend.groupBy("council", "period").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"), F.sum(row_crc(*(F.col(c) for c in columns))).alias("crc"))


def fingerprint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Missing, extra, changed or matched groups."""
    o = old.select("council", "period", F.struct("n", "total", "crc").alias("o"))
    n = new.select("council", "period", F.struct("n", "total", "crc").alias("n"))
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "extra").when(F.col("o") == F.col("n"), "matched").otherwise("changed")
    return o.join(n, ["council", "period"], "full").select("council", "period", verdict.alias("verdict"))


def with_share(df: DataFrame, measure: str) -> DataFrame:
    """Part of the total and of the largest, in per cent; for results, not for facts."""
    w = Window.partitionBy()
    return df.withColumn("share", F.round(100 * F.col(measure) / F.sum(measure).over(w), 4)).withColumn("bar", F.round(100 * F.col(measure) / F.max(measure).over(w), 4))


def supplier_directory(names: DataFrame, figures: DataFrame) -> DataFrame:
    """All suppliers, zero where there are no figures."""
    return names.join(figures, "supplier_canon", "left").na.fill(0).na.fill(0.0)


def deprivation(spend: DataFrame, config: DataFrame, reference: DataFrame, *, nation: str | None = None, fy: int | None = None, leave_out: str | None = None) -> DataFrame:
    """Spend per head against deprivation: correlation, least squares, mean and range; r is 0 where a variance is."""
    rows = spend.where(filters.live())
    rows = rows.where(filters.in_fy(fy, "period")) if fy else rows
    heads = rows.groupBy("lad_code").agg(F.sum("amount").cast("double").alias("t")).where("t > 0").join(config.where("population > 0").select("lad_code", "population"), "lad_code").join(reference.where("imd_avg_score IS NOT NULL"), "lad_code")
    heads = heads.where(F.left("lad_code", F.lit(1)) == nation) if nation else heads
    heads = heads.where(F.col("lad_code") != leave_out) if leave_out else heads
    y, x = F.col("t") / F.col("population"), F.col("imd_avg_score")
    flat = (F.var_pop(x) == 0) | (F.var_pop(y) == 0)
    return heads.agg(F.count("*").alias("areas"), F.round(F.when(flat, 0.0).otherwise(F.corr(x, y)), 6).alias("r"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 5).alias("intercept"), F.round(F.avg(y), 5).alias("mean"), F.round(F.min(y), 5).alias("low"), F.round(F.max(y), 5).alias("high"))


def overall_fy(spend: DataFrame) -> DataFrame:
    return spend.where(filters.live()).groupBy(dates.fy_from_period(F.col("period")).alias("fy")).agg(money(F.sum("amount")).alias("total"))
