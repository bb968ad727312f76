"""Contract registers and their reconciliation with payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators import filters


def _days(spend: DataFrame, rows: Column) -> DataFrame:
    """Payments per area, supplier and day: what the interval joins meet instead of payment lines."""
    return spend.where(rows & filters.named() & F.col("paid_date").isNotNull()).groupBy(F.col("lad_code").alias("_lad"), F.col("supplier_canon").alias("_canon"), F.col("paid_date").alias("_day")).agg(F.sum("amount").alias("_sum"), F.count("*").alias("_n"))


def _within(entries: DataFrame, spend: DataFrame, rows: Column, test: Column, how: str) -> DataFrame:
    on = (F.col("lad_code") == F.col("_lad")) & (F.col("supplier_canon") == F.col("_canon")) & test
    return entries.select("id", "lad_code", "supplier_canon", "start_date", "end_date").join(_days(spend, rows), on, how)


_WINDOW = lambda: (F.col("start_date").isNull() | (F.col("_day") >= F.col("start_date"))) & (F.col("end_date").isNull() | (F.col("_day") <= F.col("end_date")))


def spend_in_window(entries: DataFrame, spend: DataFrame) -> DataFrame:
    """Per contract, live payments of its area and supplier from start to end; a missing bound is open.

    Undated payments count only for contracts open on both sides.
    """
    both = _within(entries, spend, filters.live(), _WINDOW(), "left")
    return both.groupBy("id").agg(F.coalesce(F.sum("_sum"), F.lit(0)).cast("double").alias("total"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("payments"))


def spend_by_month(entries: DataFrame, spend: DataFrame) -> DataFrame:
    """J5."""
    both = _within(entries, spend, filters.live(), _WINDOW(), "inner")
    return both.groupBy("id", F.date_format("_day", "yyyy-MM").alias("month")).agg(F.sum("_sum").cast("double").alias("total"), F.sum("_n").alias("payments"))


def spend_after_end(entries: DataFrame, spend: DataFrame) -> DataFrame:
    """Payments after a contract's end; invalid ones are not excluded."""
    both = _within(entries.where("end_date IS NOT NULL"), spend, F.col("internal_provider") == 0, F.col("_day") > F.col("end_date"), "inner")
    return both.groupBy("id").agg(F.sum("_sum").cast("double").alias("total"), F.sum("_n").alias("payments"))


def overlap_counts(entries: DataFrame) -> DataFrame:
    """For each tech contract, how many others of its council and supplier overlap it.

    Counted, not paired: of n contracts, those that ended before the start and
    those that started after the end don't overlap.  Both are running counts
    over the group's ordered starts and ends, so a reseller's thousands of
    contracts cost n log n.  The count doesn't hold for contracts that end
    before they start; these few errors are paired with their group directly.
    """
    far, early = F.lit("9999-12-31").cast("date"), F.lit("0001-01-01").cast("date")
    e = entries.where("is_tech = 1 AND supplier_canon IS NOT NULL").select("id", "council", "supplier_canon", F.coalesce("start_date", early).alias("s"), F.coalesce("end_date", far).alias("e"))
    group = ["council", "supplier_canon"]
    everything, wrong = e, e.where("s > e")
    e = e.where("s <= e")
    marks = e.select(*group, "id", F.col("s").alias("at"), F.lit(1).alias("kind")).unionByName(e.select(*group, "id", F.col("e").alias("at"), F.lit(2).alias("kind")))
    # Before a start: the ends on earlier days.  After an end: the starts on later days.
    order = Window.partitionBy(*group).orderBy(F.datediff("at", F.lit("1970-01-01").cast("date")))
    ended = F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(order.rangeBetween(Window.unboundedPreceding, -1))
    later = F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order.rangeBetween(1, Window.unboundedFollowing))
    counted = marks.withColumn("out", F.coalesce(F.when(F.col("kind") == 1, ended).otherwise(later), F.lit(0)))
    gone = counted.groupBy("id", *group).agg(F.sum("out").alias("gone"))
    sizes = e.groupBy(*group).agg(F.count("*").alias("n"))
    counts = gone.join(sizes, group).select("id", (F.col("n") - 1 - F.col("gone")).cast("long").alias("n"))

    def paired(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(F.col("council").alias("_c"), F.col("supplier_canon").alias("_p"), F.col("id").alias("_id"), F.col("s").alias("_s"), F.col("e").alias("_e"))
        on = (F.col("council") == F.col("_c")) & (F.col("supplier_canon") == F.col("_p")) & (F.col("id") != F.col("_id")) & (F.col("_s") <= F.col("e")) & (F.col("_e") >= F.col("s"))
        return left.join(r, on).groupBy("id").agg(F.count("*").alias("n"))

    zero = wrong.select("id", F.lit(0).cast("long").alias("n"))
    parts = counts.unionByName(paired(everything, wrong)).unionByName(paired(wrong, e)).unionByName(zero)
    return parts.groupBy("id").agg(F.sum("n").alias("overlaps"))


def register_summary(entries: DataFrame) -> DataFrame:
    """Per council."""
    tech = F.col("is_tech") == 1
    return entries.groupBy("council").agg(F.count("*").alias("contracts"), F.count_if(tech).alias("tech"), F.coalesce(F.sum(F.when(tech, F.col("value_amount"))), F.lit(0)).cast("double").alias("tech_value"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"))


def register_kpis(entries: DataFrame) -> DataFrame:
    """A23."""
    tech = F.col("is_tech") == 1
    return entries.agg(F.count_distinct("council").alias("councils"), F.count("*").alias("contracts"), F.count_if(tech).alias("tech"), F.sum(F.when(tech, F.col("value_amount"))).cast("double").alias("tech_value"), F.count_distinct(F.when(tech, F.col("supplier_canon"))).alias("tech_suppliers"))


def register_suppliers(entries: DataFrame, keys: list[str] = ("supplier_canon",)) -> DataFrame:
    """A25."""
    return entries.where("is_tech = 1").groupBy(*keys).agg(F.count("*").alias("contracts"), F.coalesce(F.sum("value_amount"), F.lit(0)).cast("double").alias("value"), F.count_distinct("council").alias("councils"), F.max("end_date").alias("latest_end"))


def unified_suppliers(spend: DataFrame, entries: DataFrame) -> DataFrame:
    """Per council and supplier, payments beside the register; driven by payments."""
    paid = spend.where(filters.live() & filters.named()).groupBy("council", "supplier_canon").agg(F.sum("amount").cast("double").alias("total"), F.min("paid_date").alias("first_paid"), F.max("paid_date").alias("last_paid"))
    held = entries.groupBy("council", "supplier_canon").agg(F.sum("value_amount").cast("double").alias("value"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"))
    return paid.join(held, ["council", "supplier_canon"], "left")


def join_lists(files: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values of a key joined by ' / ' in file order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return files.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: x[value]), " / ").alias(value))


def loose_amount(text: Column) -> Column:
    """What stands in a cell as an amount: digits, points and signs, the number that they start with, to the penny; 0 without one."""
    found = F.regexp_extract(F.regexp_replace(text, r"[^0-9.\-]", ""), r"^-?\d*\.?\d*", 0)
    return F.round(F.coalesce(found.try_cast("double"), F.lit(0.0)), 2)


def alike(name: Column, other: Column) -> Column:
    """Whether two names are equal, one holds the other, or the second starts with the first's six characters; blank names are like none."""
    r, s = F.lower(F.trim(name)), F.lower(F.trim(other))
    same = s.contains(r) | r.contains(s) | ((F.char_length(r) >= 6) & s.startswith(F.left(r, F.lit(6))))
    return F.coalesce((r != "") & (s != "") & same, F.lit(False))


def trace_back(stored: DataFrame, source: DataFrame) -> DataFrame:
    """``stored`` with row_no, the first row of its source that explains it, or NULL.

    ``source``: source_id, row_no, supplier, amount and, for the second attempt,
    cells (all of the row's texts).  First the named columns: amounts under two
    pence apart and names alike.  For positive payments that they don't explain,
    any cell with such an amount above zero in a row with any cell like the name.
    Where a source is known to hold texts of one kind only, its columns names and
    amounts (arrays of texts) are tried in place of all cells: an amount may start
    like a name that starts with a number, and a name's digits be an amount.

    Amounts meet by the penny: a stored payment stands in its own penny and in the
    two on either side, which holds every pair under 0.02 apart.
    """
    penny = lambda c: F.round(c * 100).cast("long")
    amount = F.round(F.col("amount").cast("double"), 2)
    wanted = stored.select(F.col("id").alias("_id"), F.col("source_id").alias("_src"), F.col("supplier_raw").alias("_raw"), amount.alias("_want"))
    wanted = wanted.withColumn("_penny", F.explode(F.transform(F.array(*map(F.lit, (-2, -1, 0, 1, 2))), lambda d: penny(F.col("_want")) + d)))
    near = lambda c: F.abs(c - F.col("_want")) < F.lit(0.02)

    def first(rows: DataFrame, open_: DataFrame, test: Column) -> DataFrame:
        met = open_.join(rows, (F.col("source_id") == F.col("_src")) & (F.col("_at") == F.col("_penny")) & near(F.col("_amount")) & test)
        return met.groupBy("_id").agg(F.min("row_no").alias("row_no"))

    by_name = source.select("source_id", "row_no", "supplier", amount.alias("_amount")).withColumn("_at", penny(F.col("_amount")))
    found = first(by_name, wanted, alike(F.col("_raw"), F.col("supplier")))
    names, amounts = (c if c in source.columns else "cells" for c in ("names", "amounts"))
    if {names, amounts} <= set(source.columns):
        values = F.array_distinct(F.filter(F.transform(amounts, loose_amount), lambda v: v > 0))
        cells = source.select("source_id", "row_no", F.col(names).alias("_names"), F.explode(values).alias("_amount")).withColumn("_at", penny(F.col("_amount")))
        left = wanted.where("_want > 0").join(found, "_id", "left_anti")
        found = found.unionByName(first(cells, left, F.exists("_names", lambda c: alike(F.col("_raw"), c))))
    return stored.join(found, F.col("id") == F.col("_id"), "left").select(*stored.columns, "row_no")


def update_reference(current: DataFrame, new: DataFrame, key: str, year: str, values: list[str]) -> DataFrame:
    """Known keys only, a newer or equal year only, missing values don't overwrite."""
    n = new.select(F.col(key).alias("_k"), F.col(year).alias("_y"), *(F.col(v).alias(f"_{v}") for v in values))
    out = current.join(n, F.col(key) == F.col("_k"), "left")
    take = F.col("_y").isNotNull() & (F.col(year).isNull() | (F.col("_y") >= F.col(year)))
    for v in values:
        out = out.withColumn(v, F.when(take, F.coalesce(f"_{v}", v)).otherwise(F.col(v)))
    return out.withColumn(year, F.when(take, F.col("_y")).otherwise(F.col(year))).select(*current.columns)


def lineage_rollup(lineage: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """Every predecessor with its active tech contracts, 0 where it has none."""
    live = entries.where((F.col("is_tech") == 1) & (F.col("end_date").isNull() | (F.col("end_date") >= as_of))).groupBy(F.col("council").alias("_c")).agg(F.count("*").alias("contracts"), F.sum("value_amount").cast("double").alias("value"))
    return lineage.join(live, F.col("pred_name") == F.col("_c"), "left").select("succ_key", "pred_name", F.coalesce("contracts", F.lit(0)).cast("long").alias("contracts"), F.coalesce("value", F.lit(0.0)).alias("value"))


def shared_suppliers(lineage: DataFrame, entries: DataFrame) -> DataFrame:
    """Suppliers of two or more predecessors of one successor."""
    rows = lineage.join(entries.where("is_tech = 1"), F.col("pred_name") == F.col("council"))
    return rows.groupBy("succ_key", "supplier_canon").agg(F.count_distinct("council").alias("councils"), F.count("*").alias("contracts"), F.sum("value_amount").cast("double").alias("value")).where("councils >= 2")


def successors(rollup: DataFrame) -> DataFrame:
    """A41."""
    return rollup.groupBy("succ_key").agg(F.count("*").alias("predecessors"), F.sum("contracts").alias("contracts"), F.round(F.sum("value"), 2).alias("value"), F.count_if(F.col("contracts") > 0).alias("with_data"))


def successor_regions(lineage: DataFrame) -> DataFrame:
    """The most frequent region of the predecessors, ties to the smaller name."""
    counts = lineage.groupBy("succ_key", "region").agg(F.count("*").alias("n"))
    best = Window.partitionBy("succ_key").orderBy(F.desc("n"), "region")
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("succ_key", "region")


def mint_successor_keys(successors_: DataFrame, config: DataFrame) -> DataFrame:
    """The body's own code where one of that name exists, else LGR and a number by alphabet among the minted (a small set)."""
    own = config.select(F.col("council").alias("_c"), F.col("lad_code").alias("_code"))
    out = successors_.join(own, F.col("succ_name") == F.col("_c"), "left")
    new = out.where("_code IS NULL").select("succ_name").distinct().withColumn("_n", F.row_number().over(Window.orderBy("succ_name")))
    return out.join(new, "succ_name", "left").select("succ_name", F.coalesce("_code", F.format_string("LGR%06d", "_n")).alias("succ_key"))


def product_stats(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Per product: distinct entries and councils, value over its links."""
    return links.join(entries, F.col("entry_id") == F.col("id")).groupBy("product_id").agg(F.count_distinct("entry_id").alias("entries"), F.count_distinct("council").alias("councils"), F.coalesce(F.sum("value_amount"), F.lit(0)).cast("double").alias("value"))


def node_stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per taxonomy node (node, product_id): distinct products and entries."""
    return nodes.join(links, "product_id", "left").groupBy("node").agg(F.count_distinct("product_id").alias("products"), F.count_distinct("entry_id").alias("entries"))


def product_areas(areas: DataFrame) -> DataFrame:
    """A28."""
    return areas.groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_set("area")), ", ").alias("areas"))


def ubiquity(links: DataFrame, entries: DataFrame) -> DataFrame:
    """A38."""
    return links.join(entries, F.col("entry_id") == F.col("id")).groupBy("product_id").agg(F.count_distinct("council").alias("councils"))
