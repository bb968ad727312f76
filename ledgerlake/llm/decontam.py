"""Benchmark decontamination: documents are scanned for windows of benchmark words.

The windows of the benchmark's items are a sorted table of 64-bit hashes with
the words themselves, broadcast in blocks of at most ``BLOCK_BYTES`` of item
text.  A task takes its texts as one byte buffer: words, word hashes and window
hashes of all of them are array operations, a bit table lets few windows
through, and what the hash table then finds is verified byte by byte.

A benchmark of one block is one pass over the documents, without a shuffle.  A
larger one is one pass a block: each pass adds to the spans and items that a row
has so far, and what it leaves is kept in the shared folder, so no more than one
block is in a worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlake.llm.common import durable, named, slices

#: Bytes of item words in one broadcast table, which takes about eight times as much.
BLOCK_BYTES = 8 << 20
#: Longer items are cut into pieces of about so many bytes that share ``window - 1`` words.
PIECE_BYTES = 1 << 20
#: Bytes of text that a task looks at in one go (or one text).
SLICE_BYTES = 2 << 20
#: Bits of a window's hash that the first look uses.
SIEVE_BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
SPAN_SQL = "array<struct<start:int,stop:int>>"


def _odd(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers that follow from ``seed``."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_OF_BYTE, _OF_PLACE = _odd(256, 1), _odd(64, 2)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of many texts: A-Z lower-cased runs of ASCII letters, digits and characters beyond ASCII."""

    def __init__(self, texts: pa.Array):
        wide = pa.large_string()
        ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(wide), ""), pa.scalar("", wide), pa.scalar("\n", wide))
        self.cut = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
        raw = np.frombuffer(ended.buffers()[2], np.uint8)[self.cut[0] : self.cut[-1]] if len(ended) else np.zeros(0, np.uint8)
        self.raw, self.cut = raw, self.cut - self.cut[0]
        low = _LOWER[raw]
        word = _WORD[low]
        after = np.zeros(len(word), bool)
        after[1:] = word[:-1]
        #: Where words start and stop in the texts' bytes.
        self.begin, self.end = np.flatnonzero(word & ~after), np.flatnonzero(~word & after)
        #: All words, each with a space behind it, and where they start and stop there.
        self.joined = np.where(word, low, np.uint8(32))[word | after]
        self.stops = np.flatnonzero(self.joined == 32)
        self.starts = np.append(0, self.stops + 1)[:-1]
        #: Where the words of each text start, and the word after each word's text.
        self.first = np.searchsorted(self.begin, self.cut)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.last = np.repeat(self.first[1:], self.n)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.stops - self.starts + 1
        place = (np.arange(len(self.joined)) - np.repeat(self.starts, size)) & 63
        return _stirred(np.add.reduceat(_OF_BYTE[self.joined] * _OF_PLACE[place], self.starts))

    def windows(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``length`` words from each word on, and which of these windows stay in one text."""
        n = max(0, len(h) - length + 1)
        out = np.zeros(n, np.uint64)
        for k, m in enumerate(_odd(length, 3)):
            out += h[k : k + n] * m
        return _stirred(out), np.arange(n) + length <= self.last[:n]


class Block:
    """The windows of some items: for each length the sorted hashes, where their words stand, and the items that have them."""

    def __init__(self, pieces: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in pieces})
        number = {name: k for k, name in enumerate(self.names)}
        words = Words(pa.array([text for _, text in pieces], pa.string()))
        owner = np.array([number[name] for name, _ in pieces], np.int64)
        self.text = words.joined.tobytes()
        h, self.tables, self.groups, self.listed = words.hashes(), {}, {}, {}
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        for length in sorted({window, *words.n[(words.n > 0) & (words.n < window)].tolist()}):
            at, inside = words.windows(length, h)
            if length < window:
                inside &= (words.n[words.text[: len(at)]] == length) if len(at) else inside
            i = np.flatnonzero(inside)
            i = i[np.argsort(at[i], kind="stable")]
            if len(i):
                self.sieve[at[i] >> np.uint64(64 - SIEVE_BITS)] = True
                self.tables[length] = (at[i], words.starts[i], words.stops[i + length - 1], owner[words.text[i]])

    def group(self, length: int, a: int, b: int) -> dict[bytes, list[int]]:
        """The windows of one hash, number ``a`` up to ``b``: from what they say to the items that have them."""
        known = self.groups.get((length, a))
        if known is None:
            known = self.groups[length, a] = {}
            _, start, stop, owner = self.tables[length]
            for k in range(a, b):
                known.setdefault(self.text[start[k] : stop[k]], []).append(int(owner[k]))
        return known

    def find(self, words: Words) -> tuple[list[tuple[int, int]], list[set[tuple[int, int, bytes]]]]:
        """Of each hit window its first word and the one after it; of each text the windows that it has."""
        joined, spans, seen = words.joined.tobytes(), [], [set() for _ in words.n]
        h = words.hashes()
        for length, (known, *_) in self.tables.items():
            at, inside = words.windows(length, h)
            maybe = np.flatnonzero(inside & self.sieve[at >> np.uint64(64 - SIEVE_BITS)])
            left, right = np.searchsorted(known, at[maybe], "left"), np.searchsorted(known, at[maybe], "right")
            some = right > left
            for i, a, b in zip(maybe[some].tolist(), left[some].tolist(), right[some].tolist(), strict=True):
                here = joined[words.starts[i] : words.stops[i + length - 1]]
                if here in self.group(length, a, b):
                    spans.append((i, i + length))
                    seen[words.text[i]].add((length, a, here))
        return spans, seen

    def items(self, seen: set[tuple[int, int, bytes]]) -> list[str]:
        """The ids of the items that have any of these windows; kept for a while, as copies of a passage have the same ones."""
        key = frozenset(seen)
        if key not in self.listed:
            if len(self.listed) >= 5_000:
                self.listed.clear()
            self.listed[key] = [self.names[k] for k in sorted({k for length, a, here in seen for k in self.groups[length, a][here]})]
        return self.listed[key]


def _pieces(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1, size=SLICE_BYTES):
            words = Words(batch.column(1))
            joined, names, out = words.joined.tobytes(), [], []
            for k, name in enumerate(batch.column(0).to_pylist()):
                i, end = int(words.first[k]), int(words.first[k + 1])
                while i < end:
                    # As many words as fit in a piece, but a window at least.
                    stop = int(np.searchsorted(words.stops, words.starts[i] + PIECE_BYTES, "right"))
                    stop = min(end, max(stop, i + window))
                    names.append(name or "")
                    out.append(joined[words.starts[i] : words.stops[stop - 1]].decode())
                    i = end if stop == end else stop - window + 1
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "piece": pa.array(out, pa.string())})

    return cut


def blocks(items: DataFrame, window: int, *, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items' windows in tables of at most ``block_bytes`` of words each (or one piece), one at a time; a single empty one for no items.

    The pieces are dealt by a hash of what they are; there are as many blocks as
    it takes for none to be over the bound.  Only one block's pieces are brought
    to the driver at a time.
    """
    pieces = items.select(F.coalesce(named([item_id])[0].cast("string"), F.lit("")).alias("name"), *named([text], ["t"])).mapInArrow(_pieces(window), "name string, piece string")
    pieces = durable(pieces.dropDuplicates(["name", "piece"]).withColumn("size", F.octet_length("piece") + 1))
    total, rows = pieces.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = math.ceil(total / block_bytes)
    block = lambda n: F.pmod(F.xxhash64("name", "piece"), F.lit(n))
    while n > 1 and n < 4 * rows and pieces.groupBy(block(n)).agg(F.sum("size").alias("s"), F.count("*").alias("c")).where(f"s > {block_bytes} AND c > 1").limit(1).count():
        n += max(1, n // 4)
    if n <= 1:
        yield Block([tuple(r) for r in pieces.select("name", "piece").collect()], window)
        return
    for k in range(n):
        if found := [tuple(r) for r in pieces.where(block(n) == k).select("name", "piece").collect()]:
            yield Block(found, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan(shared, keep_text: bool, cut: bool):
    """One pass: (row, t, n_words, spans, items) of earlier passes with this block's spans and items added.

    Spans are of words; with ``cut`` the text loses them, each from its first
    word's first byte to its last word's last.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches, rows=2000, text=1, size=SLICE_BYTES):
            words = Words(batch.column(1))
            found, seen = block.find(words)
            spans: list[list] = [[] for _ in words.n]
            for a, b in found:
                t, f = words.text[a], int(words.first[words.text[a]])
                spans[t].append((a - f, b - f))
            spans = [_merged(new + [(x["start"], x["stop"]) for x in old]) if new or old else [] for new, old in zip(spans, batch.column(2).to_pylist(), strict=True)]
            names = [sorted({*old, *block.items(new)}) if new and old else block.items(new) if new else old for new, old in zip(seen, batch.column(3).to_pylist(), strict=True)]
            texts = batch.column(1)
            if cut and any(spans):
                texts = pa.array([_without(t.encode(), s, words, k) if s else t for k, (t, s) in enumerate(zip(texts.to_pylist(), spans, strict=True))], pa.string())
            out = {"row": batch.column(0)} | ({"t": texts} if keep_text else {})
            out |= {"n_words": pa.array(words.n, pa.int64()), "spans": pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], SPAN), "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return scan


def _without(text: bytes, spans: list[tuple[int, int]], words: Words, k: int) -> str:
    f, at, out, done = int(words.first[k]), int(words.cut[k]), [], 0
    for a, b in spans:
        out.append(text[done : int(words.begin[f + a]) - at])
        done = int(words.end[f + b - 1]) - at
    return b"".join([*out, text[done:]]).decode()


def marked(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, cut: bool = False, keep_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, t, n_words, n_hit, spans, items) for every row of ``docs``: row has its other columns, t its text.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but some, is one window.  n_hit counts the words inside any occurrence of a
    window, spans has them as runs of word numbers (stop excluded), items has
    the ids, as sorted strings, of the items whose windows occur.  With ``cut``
    the text loses its spans.

    Null and empty texts have no words and stay as they are.  Items of one id
    are one item; their windows don't reach from row to row.  A null id is the
    empty string.  Repeated documents are rows of their own.  Without items no
    word is hit.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text]
    row = F.struct(*named(others)) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), *named([text], ["t"]), F.lit(None).cast(SPAN_SQL).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    rows = rows.withColumns({"spans": F.coalesce("spans", F.array().cast(SPAN_SQL)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    schema = StructType([rows.schema["row"], rows.schema["t"], StructField("n_words", LongType()), rows.schema["spans"], rows.schema["items"]])
    todo = blocks(items, window, item_id=item_id, text=item_text, block_bytes=block_bytes)
    block = next(todo)
    while True:
        after = next(todo, None)
        last = after is None
        with_text = keep_text or not last
        kept = StructType([f for f in schema if with_text or f.name != "t"])
        rows = rows.select("row", "t", "spans", "items").mapInArrow(_scan(spark.sparkContext.broadcast(block), with_text, cut and last), kept)
        if last:
            hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
            return rows.withColumn("n_hit", hit)
        rows, block = durable(rows), after


def digests(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``; see ``marked``."""
    out = marked(docs.select(*named([id_col, text])), items, text=text, keep_text=False, **how)
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return out.select(F.col("row")[id_col].alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", remove: str = "spans", most: float = 0.0, **how) -> DataFrame:
    """``docs``, its own columns, without what the benchmark's windows hit.

    ``remove="spans"`` cuts the hit words, and what stands between them, from
    the texts; ``remove="documents"`` drops the rows with more than ``most`` of
    their words hit.  Rows without a hit stay as they are, null texts too.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    out = marked(docs, items, text=text, cut=remove == "spans", **how)
    if remove == "documents":
        out = out.where(F.col("n_hit") <= F.col("n_words") * F.lit(most))
    return out.select(*((F.col("t") if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
