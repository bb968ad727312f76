"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import ROWS_A_TASK, durable


def components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Alternating large-star and small-star rounds: each is one grouping, links
    only ever get replaced by links to smaller nodes, and their number never
    grows.  A round's table is kept in the checkpoint folder; only its size and
    checksum come to the driver.  A node's neighbours are never gathered: the
    minimum is aggregated and joined back, so a hub is one more row in a join
    that Spark may split.  The number of tasks follows the counted links: a
    table of at most ``ROWS_A_TASK`` is one partition, and a round over it has
    no shuffle.  No links in, no rows out.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _state(edges)
    for _ in range(max_rounds):
        edges = edges.coalesce(max(1, math.ceil(seen[0] / ROWS_A_TASK)))
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its neighbours below go to the smallest of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = durable(small.where("u <> v").distinct())
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
