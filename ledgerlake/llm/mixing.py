"""Mixing sources to target weights by Sainte-Lague apportionment.

DataFrame operations only; no text is moved, only (id, source, size).

The words of a source are cut into blocks of equal size.  Blocks are given to
sources by highest quotients target / (2k - 1), and a source's blocks to its
shards in the same way by their sizes, so every shard knows its integer quota
before any document is picked.  In a shard the documents stand in a seeded
order; whole passes are taken as often as the quota allows, and the rest is a
seeded run of neighbouring blocks.

Quotients are not listed block by block.  A party's seats differ from its
proportional share by a bounded number, so each party lists only the seats in
that range (about 2.5 rows a party in all) and the rest is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import WORD, durable, named

#: Documents of a source that one task orders, on average.
SHARD_ROWS = 20_000
#: Words in a block.
BLOCK_WORDS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, weights: list[int], max_repeat: int) -> DataFrame:
    """``sources`` (source, total) with weight and target.

    Weights repeat over the sources in code-point order, null last.  The sum of
    all sizes is shared by weight; no target exceeds ``max_repeat`` times its
    source's size, and the excess is shared by weight among the others.  That
    fixed point is min(weight * level, cap) with one level for all: sources are
    filled in order of cap / weight, and the level is what the uncapped ones
    share.  One row a source is ordered here, never one a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*map(F.lit, weights))
    s = sources.withColumn("weight", F.get(wheel, (F.row_number().over(by_name) - 1) % len(weights)).cast("long")).withColumn("cap", max_repeat * F.col("total"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The level if this source and all after it were open; the right one is the first that its source's cap allows.
    s = s.withColumn("level", (F.sum("total").over(everything) - F.col("capped")).cast("double") / F.col("open"))
    s = s.withColumn("level", F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(everything))
    share = F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    return s.select("source", "total", "weight", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def sainte_lague(parties: DataFrame, *, within: list[str], key: Column, votes: str, seats: str) -> DataFrame:
    """``parties`` with quota: their part of ``seats`` (equal in each group of ``within``) by highest quotients.

    Ties go to the smaller ``key``.  Rank is taken over the few contested seats
    of each party, not over all of them.
    """
    group = Window.partitionBy(*within)
    p = parties.withColumn("_n", F.count("*").over(group)).withColumn("_all", F.sum(F.col(votes).cast("double")).over(group))
    share = F.when(F.col("_all") > 0, F.col(seats) * F.col(votes).cast("double") / F.col("_all")).otherwise(F.lit(0.0))
    # With the divisor moved by this factor, the seats rounded down (up) are surely too few (many).
    slack = F.col("_n") / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    sure = F.greatest(F.floor(share * (1 - slack) - 1), F.lit(0)).cast("long")
    most = (F.ceil(share * (1 + slack)) + 1).cast("long")
    p = p.withColumn("_sure", sure).withColumn("_free", F.col(seats) - F.sum(sure).over(group))
    contested = p.withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.greatest(most, F.col("_sure") + 1))))
    best = Window.partitionBy(*within).orderBy((F.col(votes).cast("double") / (2 * F.col("_k") - 1)).desc(), key, F.col("_k"))
    contested = contested.withColumn("_rank", F.row_number().over(best))
    won = F.sum(F.when((F.col("_rank") <= F.col("_free")) & (F.col(votes) > 0), 1).otherwise(0))
    names = parties.columns
    return contested.groupBy(*names, "_sure").agg(won.alias("_won")).select(*names, (F.col("_sure") + F.col("_won")).alias("quota"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = "mix-1", tag: Column | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, passes, cut, tag) for every row of ``docs``.

    A document is taken whole ``passes`` times, and besides in the runs of words
    of ``cut`` (from, words), of which there are none, one or two.  It never
    gives more than ``max_repeat`` times its size.  Null texts have size 0, a
    null source is a source of its own.  The seeded order is md5(seed, id), then
    size, then ``tag`` (a number of the row's content, for callers that need it):
    rows that tie in all are interchangeable, so reruns agree, also with
    repeated rows.  No rows in, no rows out.  Sources are ordered in one task,
    a few numbers each: millions of them are no trouble, one a document would be.
    """
    sized = docs.select(*named([id_col, source], ["id", "source"]), word_count(*named([text])).alias("size"), (F.lit(0).cast("long") if tag is None else tag).alias("tag"))
    sized = durable(sized.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")).cast("binary"))))
    rows = sized.count()
    shards = max(1, -(-rows // shard_rows))
    # Rows that share an id are apart too when their sizes differ.
    sized = sized.withColumn("shard", (F.conv(F.substring("draw", 25, 8), 16, 10).cast("long") + F.col("size")) % shards)
    cells = durable(sized.groupBy("source", "shard").agg(F.sum("size").alias("words")))

    totals = cells.groupBy("source").agg(F.sum("words").alias("total"))
    targets = source_targets(totals, weights=list(weights), max_repeat=max_repeat)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    quotas = sainte_lague(targets.withColumn("blocks", blocks), within=[], key=F.col("source").asc_nulls_last(), votes="target", seats="blocks")
    quotas = quotas.select(F.col("source").alias("s"), F.col("total").alias("source_size"), "target", F.col("quota").alias("source_blocks"))
    parties = cells.join(quotas, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shares = sainte_lague(parties, within=["source"], key=F.col("shard"), votes="words", seats="source_blocks")
    # How the quota is taken: whole passes, then a run of neighbouring blocks from a seeded start, around the end.
    take = F.least(F.col("quota") * block_words, max_repeat * F.col("words"))
    shares = shares.select(
        F.col("source").alias("s"), F.col("shard").alias("h"), "source_size", "target", "words",
        F.when(F.col("words") > 0, F.floor(take / F.col("words"))).otherwise(0).cast("long").alias("passes"),
        F.when(F.col("words") > 0, take % F.col("words")).otherwise(0).alias("rest"),
        F.when(F.col("words") > 0, (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("source"), F.col("shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.ceil(F.col("words") / block_words)) * block_words).otherwise(0).alias("start"),
    )
    shares = durable(shares)

    line = Window.partitionBy("source", "shard").orderBy("draw", "size", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    both = placed.join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))

    stop = F.col("start") + F.col("rest")

    def overlap(lo: Column, hi: Column) -> Column:
        since = F.greatest(F.col("begin"), lo)
        return F.struct((since - F.col("begin")).cast("long").alias("since"), F.greatest(F.least(F.col("end"), hi) - since, F.lit(0)).cast("long").alias("words"))

    cut = F.filter(F.array(overlap(F.col("start"), F.least(stop, F.col("words"))), overlap(F.lit(0), stop - F.col("words"))), lambda c: c["words"] > 0)
    return both.select(F.col("id").alias(id_col), "size", "source", "source_size", F.col("target").cast("double").alias("target"), "passes", cut.alias("cut"), "tag")


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``: taken counts the words that the mix takes, repeats included."""
    part = F.aggregate("cut", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return plan(docs, id_col=id_col, **options).select(*named([id_col]), "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each whole pass over a document and one for each run of its words.

    Runs are joined by single spaces.  Documents without words add none.  Rows
    with equal content are interchangeable: each kind of row is met once and
    given as often as the takes of all its copies say.
    """
    tag = F.xxhash64(*named(docs.columns))
    takes = plan(docs, id_col=id_col, text=text, tag=tag, **options).where("size > 0")
    whole = F.transform(F.sequence(F.lit(1), F.col("passes").cast("int")), lambda i: F.struct(F.lit(-1).cast("long").alias("since"), F.lit(0).cast("long").alias("words")))
    takes = takes.select(*named([id_col], ["i"]), "tag", F.explode(F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.filter("cut", lambda c: F.lit(False))), "cut")).alias("take"))
    takes = takes.groupBy("i", "tag", "take").agg(F.count("*").alias("times"))
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), *named([id_col], ["j"]), tag.alias("h")).dropDuplicates(["h", "j"])
    both = rows.join(takes, F.col("i").eqNullSafe(F.col("j")) & (F.col("tag") == F.col("h")))
    body = F.col("row")[text]
    run = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(f"({WORD})"), 1), (F.col("take.since") + 1).cast("int"), F.col("take.words").cast("int")), " ")
    new = F.when(F.col("take.since") < 0, body).otherwise(run)
    out = both.select(*((new if c == text else F.col("row")[c]).alias(c) for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__time"))
    return out.toDF(*docs.columns, "__time").select(*named(docs.columns))
