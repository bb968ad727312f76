"""Token counts by a two-tier lookup that moves no pre-token between tasks.

Tier one is a compact table of the corpus' frequent pre-tokens and their token
lengths, broadcast to every worker.  Tier two is a bounded cache in each Python
worker for the rest, filled by the tokenizer library, one pre-token at a time.

A pre-token of a piece model is a run of spaces and the characters up to the
next space.  That cut is exact where no piece of the vocabulary has a space
after another character, which ``check_separable`` verifies on the model.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable, named, slices

#: Entries of the broadcast table; with the pre-token lengths capped below it stays under 8 MB.
HOT_ENTRIES = 65_536
HOT_CHARS = 48
#: What one task reports to the table, and what it holds while it counts.
PER_TASK = 4_096
#: Lists that one task merges.
FAN = 64
HELD = 200_000
#: Entries of a worker's cache; it is emptied when full.
CACHE_ENTRIES = 500_000
CACHE_CHARS = 200

_RUNS = re.compile("▁+[^▁]*|[^▁]+")
_caches: dict[str, "Lengths"] = {}


def pre_tokens(text: str) -> list[str]:
    """Keys of a text: a word stands for one space and the word, a longer run of spaces is kept in front."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:].replace("▁", " ") for run in _RUNS.findall("▁" + text.replace(" ", "▁"))]


def check_separable(processor) -> None:
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} spans pre-tokens; this model can't be counted by pre-token")


def load(path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    check_separable(processor)
    return processor


class Lengths(dict):
    """Tier one as the dict itself, tier two behind ``__missing__``."""

    def __init__(self, path: str, hot: dict[str, int]):
        super().__init__(hot)
        self.encode, self.cold = load(path).encode, {}
        self[""] = len(self.encode("a ")) - len(self.encode("a"))  # one space that ends a text

    def __missing__(self, key: str) -> int:
        n = self.cold.get(key)
        if n is None:
            n = len(self.encode(key))
            if len(key) <= CACHE_CHARS:
                if len(self.cold) >= CACHE_ENTRIES:
                    self.cold.clear()
                self.cold[key] = n
        return n


def _top(held: Counter[str], n: int) -> pa.RecordBatch:
    top = heapq.nsmallest(n, held.items(), key=lambda x: (-x[1], x[0]))
    return pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    for batch in slices(batches, text=0):
        for text in batch.column(0).to_pylist():
            held.update(pre_tokens(text or ""))
            if len(held) > HELD:
                held = Counter(dict(heapq.nlargest(HELD // 4, held.items(), key=lambda x: x[1])))
    yield _top(Counter({k: n for k, n in held.items() if len(k) <= HOT_CHARS}), PER_TASK)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    for batch in batches:
        for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[key] += n
    yield _top(held, HOT_ENTRIES)


def hot_table(docs: DataFrame, model_path: str, text: str = "text") -> dict[str, int]:
    """Token lengths of the frequent pre-tokens of all of ``docs``; at most HOT_ENTRIES of at most HOT_CHARS characters.

    Each task lists its own most frequent pre-tokens; the lists are merged FAN at a
    time, by the partitions they are in and not by their keys, until one is left.
    Which pre-tokens are in it changes the speed only, never a count.
    """
    lists = docs.select(*named([text], ["t"])).mapInArrow(_frequent, "key string, n long")
    while True:
        lists = durable(lists)
        parts = lists.rdd.getNumPartitions()
        if parts <= FAN:
            break
        # Neighbouring partitions are read by one task: nothing is shuffled.
        lists = lists.coalesce(-(-parts // FAN)).mapInArrow(_merged, "key string, n long")
    keys = [r["key"] for r in lists.coalesce(1).mapInArrow(_merged, "key string, n long").collect()]
    return dict(zip(keys, map(len, load(model_path).encode(keys, num_threads=1)), strict=True)) if keys else {}


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null or empty text: no bytes, no tokens.  Rows stand for themselves, so
    repeated rows and null ids give a row each.  Other columns are not read.
    """
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_table(docs, model_path, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _caches.get(model_path)
        if known is None or known.source is not hot.value:
            known = _caches[model_path] = Lengths(model_path, hot.value)
            known.source = hot.value
        of = known.__getitem__
        for batch in slices(batches, text=2):
            n = [sum(map(of, pre_tokens(t))) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(*named([id_col], ["id"]), F.coalesce(F.octet_length(*named([text])), F.lit(0)).cast("long").alias("n_bytes"), *named([text], ["t"]))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
