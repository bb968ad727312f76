"""Line dedup: lines that many documents share are dropped from all of them.

DataFrame operations only.  Nothing moves by a key that the data can make hot:

1. every document's distinct line keys are hashed (128 bits) and counted, with
   partial counts before the shuffle, so a line in a third of all documents
   arrives as one row per task;
2. the keys over the threshold meet the (text, key, position) rows: broadcast
   while they are few, shuffled beyond that;
3. each text's dropped positions meet the documents by the text's own hash, in
   a left join whose document side Spark may split.

What is dropped depends on the text alone, so exact copies share one row of
dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import BLANKS, ascii_lower, durable, named

#: Up to this many shared keys (16 bytes each) the keys are broadcast, beyond it they are shuffled.
BROADCAST_KEYS = 500_000


def _wide_hash(value: Column, first: str, second: str) -> list[Column]:
    return [F.xxhash64(value).alias(first), F.xxhash64(F.lit(7), value).alias(second)]


def shared_lines(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept (the text that stays) beside its own columns (which lose these names).

    A line is what stands between ``\\n``; its key is the line without ASCII
    white space at its ends and with A-Z lower-cased.  Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` rows lose all
    their lines.  Each row counts as one document, also where ids are null or
    repeated.  Null and empty texts have one empty line.  No rows in, no rows
    out.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    body = F.coalesce(*named([text]), F.lit(""))
    keys = F.transform(F.split(ascii_lower(body), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    long_enough = F.char_length("k") >= min_chars

    counted = docs.select(F.explode(F.array_distinct(keys)).alias("k")).where(long_enough).groupBy(*_wide_hash(F.col("k"), "a", "b"))
    shared = durable(counted.agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b"))
    few = shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS

    lines = docs.select(*_wide_hash(body, "t1", "t2"), F.posexplode(keys).alias("pos", "k")).where(long_enough)
    lines = lines.select("t1", "t2", "pos", *_wide_hash(F.col("k"), "a", "b"))
    hits = lines.join(F.broadcast(shared) if few else shared, ["a", "b"], "left_semi")
    dropped = hits.groupBy("t1", "t2").agg(F.collect_set("pos").alias("dropped"))

    whole = docs.select(F.struct(*named(own)).alias("row"), *_wide_hash(body, "t1", "t2")).join(dropped, ["t1", "t2"], "left")
    body = F.coalesce(F.col("row")[text], F.lit(""))
    split = F.split(body, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "dropped")
    kept = F.when(F.col("dropped").isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return whole.select(*(F.col("row")[c].alias(c) for c in own), F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row."""
    out = shared_lines(docs.select(*named([id_col, text])), text=text, **limits)
    return out.select(*named([id_col]), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, *, text: str = "text", **limits: int) -> DataFrame:
    """``docs``, all of its columns, with the kept lines as its text; where nothing is dropped the text stays as it was, null too."""
    out = shared_lines(docs.select(F.struct(*named(docs.columns)).alias("doc"), *named([text], ["text"])), **limits)
    new = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("doc")[text])
    return out.select(*((new if c == text else F.col("doc")[c]).alias(c) for c in docs.columns))
