"""Logic over ordered rows: ambiguous dates, cadence, overdue sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.dates import month_index


#: Lines of a file that one task orders.
BLOCK_LINES = 100_000


def carried(rows: DataFrame, group: str, line: str, value: str, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``rows`` with _before and _after: the nearest ``value`` that isn't NULL at or before, and at or after, each row of its group.

    A group may be one huge file, so nothing orders it whole: lines stand in
    blocks, each block is filled by itself, and what blocks start and end with is
    scanned over one row a block and carried into those that lack it.
    """
    r = rows.withColumn("_block", F.floor(F.col(line) / block_lines))
    seen = F.when(F.col(value).isNotNull(), F.col(line))
    ends = r.groupBy(group, "_block").agg(F.max_by(value, seen).alias("_last"), F.min_by(value, seen).alias("_first"))
    across = Window.partitionBy(group).orderBy("_block")
    carry = ends.select(
        F.col(group).alias("_g"), F.col("_block").alias("_b2"), F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
        F.first("_first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_out"),
    )
    within = Window.partitionBy(group, "_block").orderBy(line)
    r = r.withColumns({"_near": F.last(value, True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.first(value, True).over(within.rowsBetween(0, Window.unboundedFollowing))})
    r = r.join(carry, F.col(group).eqNullSafe(F.col("_g")) & F.col("_block").eqNullSafe(F.col("_b2")), "left")
    return r.withColumns({"_before": F.coalesce("_near", "_in"), "_after": F.coalesce("_next", "_out")}).drop("_block", "_b2", "_g", "_near", "_next", "_in", "_out")


def numbered(rows: DataFrame, group: str, line: str, name: str, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``rows`` with their number (from 0) in their group, by line: numbers in blocks, and the blocks' sizes added up."""
    r = rows.withColumn("_block", F.floor(F.col(line) / block_lines))
    sizes = r.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_off"))
    r = r.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_block").orderBy(line)))
    r = r.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col("_block").eqNullSafe(F.col("_b")))
    return r.withColumn(name, F.col("_off") + F.col("_rn") - 1).drop("_block", "_b", "_g", "_off", "_rn")


def resolve_day_month(rows: DataFrame, *, file: str = "file", line: str = "line", text: str = "date_text", block_lines: int = BLOCK_LINES) -> DataFrame:
    """W1: 'a/b/yyyy' dates, where a file mixes day-first and month-first blocks.

    A row with a part over 12 shows its block's order; both over 12 is dropped.
    Other rows take the order of the nearest telling rows before and after: if
    these agree, theirs; if not, the one that puts the date in the month of its
    telling row before or else after; without any, day first.  Lines are whole
    numbers; a file is spread over tasks by blocks of them (``carried``).
    """
    part = lambda k: F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})", k).try_cast("int")
    r = rows.withColumn("_a", part(1)).withColumn("_b", part(2)).withColumn("_y", part(3)).where("NOT coalesce(_a > 12 AND _b > 12, false)")
    r = r.withColumn("_own", F.when(F.col("_a") > 12, "d").when(F.col("_b") > 12, "m"))
    r = r.withColumn("_month", F.when(F.col("_own") == "d", F.col("_b")).when(F.col("_own") == "m", F.col("_a")))
    r = r.withColumn("_known", F.when(F.col("_own").isNotNull(), F.struct("_own", "_month")))
    r = carried(r, file, line, "_known", block_lines=block_lines)
    before, after = F.col("_before._own"), F.col("_after._own")
    month_as = lambda style: F.when(style == "d", F.col("_b")).otherwise(F.col("_a"))
    edge = F.when(month_as(before) == F.col("_before._month"), before).when(month_as(after) == F.col("_after._month"), after).otherwise(before)
    style = F.coalesce("_own", F.when(before.isNull() | after.isNull() | (before == after), F.coalesce(before, after)).otherwise(edge), F.lit("d"))
    month, day = month_as(style), F.when(style == "d", F.col("_a")).otherwise(F.col("_b"))
    made = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", "_y", month, day), F.lit("yyyy-MM-dd")).cast("date")
    return r.withColumn("date", F.when(F.col("_y").isNotNull(), made)).drop("_a", "_b", "_y", "_own", "_month", "_known", "_before", "_after")


def cadence(spend: DataFrame, months: int = 13) -> DataFrame:
    """Per council the modal gap between its last distinct months, snapped to 1, 3, 6 or 12 months.

    Ties go to the gap seen first, newest months first.  Under three months: 1,
    with low confidence.
    """
    held = spend.select("council", month_index(F.col("period")).alias("m")).distinct()
    w = Window.partitionBy("council").orderBy(F.desc("m"))
    last = held.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= months)
    gaps = last.withColumn("gap", F.lag("m").over(w) - F.col("m"))
    n = gaps.groupBy("council").agg(F.count("*").alias("months"), F.max("m").alias("newest"))
    by_gap = gaps.where("gap IS NOT NULL").groupBy("council", "gap").agg(F.count("*").alias("_n"), F.min("_r").alias("_first"))
    mode = by_gap.withColumn("_o", F.row_number().over(Window.partitionBy("council").orderBy(F.desc("_n"), "_first"))).where("_o = 1").select("council", "gap")
    snapped = F.when(F.col("gap") <= 1, 1).when(F.col("gap") <= 4, 3).when(F.col("gap") <= 8, 6).otherwise(12)
    out = n.join(mode, "council", "left")
    low = F.col("months") < 3
    return out.select("council", "months", "newest", F.when(low, 1).otherwise(F.coalesce(snapped, F.lit(1))).alias("cadence"), F.when(low, "low").otherwise("high").alias("confidence"))


def overdue(cadences: DataFrame, as_of: Column, lag: int = 2) -> DataFrame:
    """Councils whose newest month is older than their cadence and a lag allow (a month more for quarterly and rarer)."""
    now = F.year(as_of) * 12 + F.month(as_of) - 1
    allowed = F.col("cadence") + lag + F.when(F.col("cadence") >= 3, 1).otherwise(0)
    return cadences.withColumn("months_late", now - F.col("newest") - allowed).where("months_late > 0")


def stale_registers(registers: DataFrame, as_of: Column) -> DataFrame:
    """Active registers never fetched, or not within the days that their note allows (monthly 45, quarterly 120, annual 400, else 120)."""
    note = F.lower(F.coalesce("note", F.lit("")))
    days = F.when(note.contains("month"), 45).when(note.contains("quarter"), 120).when(note.contains("annual"), 400).otherwise(120)
    return registers.where("active = 1").where(F.col("last_fetched").isNull() | (F.datediff(as_of, "last_fetched") > days))
