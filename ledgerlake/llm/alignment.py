"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers have to cut a text before a space that stands between another
character and a character that is no white space.  What lies between two such
cuts is a *unit* (a word, mostly): it is encoded once for each worker's bounded
store, and a text's tokens are its units' tokens, one after the other.

Alignment is a merge in lockstep.  The texts of a batch are lanes (long texts
several, cut between units); one state vector has each lane's A and B pointer.
A step links the two tokens that every lane points at, then advances the token
that ends first, or both, which is a cut; lanes that are finished leave the
vector.

How often an id pair is linked in the whole corpus is counted from each
document's distinct pairs, which are kept, compressed, in the shared folder.
The most frequent pairs are broadcast, which with a large corpus is most of all
links; the rest of the links meet their counts in a join that has no hot key.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlake.llm.common import bounded, bytes_of, durable, named, slices
from ledgerlake.llm.token_counts import load as load_pieces

#: Units, and bytes of text in them, that a worker's store holds before it starts anew.
STORE_UNITS, STORE_BYTES = 500_000, 32 << 20
#: Tokens of both tokenizers that a lane has at least, if its text has; it ends with the unit that reaches them.
LANE_TOKENS = 256
#: Bytes of text in a batch (or one text).
BATCH_BYTES = 1 << 20
#: Id pairs that are broadcast with their counts (17 bytes each).
HOT_PAIRS = 1_000_000
#: Distinct pairs that a task holds while it counts.
HELD_PAIRS = 2_000_000

_CUT = re.compile(r"(?<=[^ ])(?= \S)")
#: A space that no unit starts with: white space follows, or nothing, or the text starts with white space.
_ODD = re.compile(r" (?!\S)|\A\s")
_stores: dict[tuple[str, str], "Store"] = {}


def byte_values() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class ByteLevel:
    """Tokenizer A: a byte-level model, special tokens in texts read as plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        values = byte_values()
        self.bytes = [bytes(values[c] for c in self.model.id_to_token(i)) if all(c in values for c in self.model.id_to_token(i)) else b"" for i in range(self.model.get_vocab_size())]

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a piece model, which puts a space in front itself."""

    def __init__(self, path: str):
        self.model = load_pieces(path)
        m = self.model
        piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = [piece(i) for i in range(m.get_piece_size())]

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


def units_of(text: str) -> list[str]:
    """The units of a space and the text, each without its first space."""
    if not _ODD.search(text):
        return text.split(" ")
    return [u[1:] for u in _CUT.split(" " + text)]


class Flat:
    """Growing lists of numbers, one after the other."""

    def __init__(self):
        self.data, self.n = np.zeros(1 << 12, np.int32), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Store:
    """Units and their tokens by both tokenizers; numbers of units are good until the next call of ``tokens``."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        #: Ids of B that a pair's number has room for.
        self.base = len(self.sides[1].bytes)
        self.sizes = [np.array([len(b) for b in side.bytes], np.int32) for side in self.sides]
        self.empty()
        width = len(str(max(len(side.bytes) for side in self.sides)))
        texts = [str(i).encode() for i in range(max(len(side.bytes) for side in self.sides))]
        self.digits = np.zeros((len(texts), width + 1), np.uint8)
        self.digits_n = np.array([len(t) for t in texts])
        for i, t in enumerate(texts):
            self.digits[i, : len(t)] = np.frombuffer(t, np.uint8)

    def empty(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes, self.good = 0, Flat()
        self.ids, self.cuts = (Flat(), Flat()), (Flat(), Flat())
        for cut in self.cuts:
            cut.add(np.zeros(1, np.int32))

    def learn(self, units: list[str]) -> None:
        good = np.ones(len(units), bool)
        raw = [(" " + u).encode() for u in units]
        for side, ids, cuts in zip(self.sides, self.ids, self.cuts, strict=True):
            found = side.encode(units)
            good &= np.array([b"".join(map(side.bytes.__getitem__, f)) == r for f, r in zip(found, raw, strict=True)], bool)
            ids.add(np.fromiter((i for f in found for i in f), np.int32))
            cuts.add(cuts.data[cuts.n - 1] + np.cumsum([len(f) for f in found], dtype=np.int32))
        self.good.add(good)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.bytes += sum(map(len, raw))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, and where each text's start; none of a text that a tokenizer does not give back."""
        if len(self.known) > STORE_UNITS or self.bytes > STORE_BYTES:
            self.empty()
        split = [units_of(t) if t else [] for t in texts]
        fresh = [u for u in dict.fromkeys(u for units in split for u in units) if u not in self.known]
        if fresh:
            self.learn(fresh)
        of = self.known.__getitem__
        n = np.array([len(units) for units in split])
        units = np.fromiter((of(u) for units in split for u in units), np.int64, int(n.sum()))
        bad = np.bincount(np.repeat(np.arange(len(n)), n), self.good.data[units] == 0, len(n)) > 0
        if bad.any():
            units, n = units[~np.repeat(bad, n)], np.where(bad, 0, n)
        return units, np.concatenate(([0], np.cumsum(n)))

    def tokens(self, units: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of these units, and where each unit's start."""
        cuts = self.cuts[side].data
        begin, n = cuts[units].astype(np.int64), (cuts[units + 1] - cuts[units]).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(n)))
        return self.ids[side].data[np.repeat(begin - at[:-1], n) + np.arange(at[-1])], at


class Aligned:
    """The tokens of a batch of texts by both tokenizers, their links and their cuts.

    ids, first: token ids, and where each text's start, by side.  link: pairs of
    token numbers.  ends: by side, which tokens are the last of their group.
    """

    def __init__(self, store: Store, texts: list[str | None]):
        units, cut = store.numbers(texts)
        self.ids, at = map(list, zip(*(store.tokens(units, side) for side in (0, 1)), strict=True))
        self.first = [a[cut] for a in at]
        lanes = self._lanes(at[0] + at[1], cut)
        #: Where tokens end, in bytes of all texts together.
        stop = [np.cumsum(size[ids], dtype=np.int64) for size, ids in zip(store.sizes, self.ids, strict=True)]
        self.ends = [np.zeros(len(ids), bool) for ids in self.ids]
        self.link = self._merged(stop, [a[lanes] for a in at])

    @staticmethod
    def _lanes(tokens: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Numbers of the units that lanes start at, and of the one behind the last: texts' starts, and units that begin another LANE_TOKENS."""
        starts = cut[:-1][np.diff(cut) > 0]
        if not len(starts):
            return np.zeros(1, np.int64)
        owner = np.searchsorted(starts, np.arange(len(tokens) - 1), "right") - 1
        block = (tokens[:-1] - tokens[starts[owner]]) // LANE_TOKENS
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
        return np.append(np.flatnonzero(new), len(block))

    def _merged(self, stop: list[np.ndarray], lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        (stop_a, stop_b), (ends_a, ends_b) = stop, self.ends
        # Lanes end in both tokenizers at once: one end tells both.
        a, b, end = lanes[0][:-1].copy(), lanes[1][:-1].copy(), lanes[0][1:].copy()
        linked_a, linked_b = [], []
        while len(a):
            linked_a.append(a)
            linked_b.append(b)
            to_a, to_b = stop_a[a], stop_b[b]
            both = to_a == to_b
            ends_a[a[both]] = True
            ends_b[b[both]] = True
            a = a + (to_a <= to_b)
            b = b + (to_b <= to_a)
            open_ = a < end
            if not open_.all():
                a, b, end = a[open_], b[open_], end[open_]
        return (np.concatenate(linked_a), np.concatenate(linked_b)) if linked_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def text_of(self, side: int) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.first[side]) - 1), np.diff(self.first[side]))

    def pairs(self, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text in order and how often they are linked, where each text's start, and its links."""
        a, b = self.link
        n = len(self.first[0]) - 1
        text = self.text_of(0)[a]
        pair = self.ids[0][a].astype(np.int64) * base + self.ids[1][b]
        order = np.lexsort((pair, text))
        text, pair = text[order], pair[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(fresh)
        return pair[at], np.diff(np.append(at, len(pair))), np.searchsorted(text[at], np.arange(n + 1)), np.bincount(text, minlength=n)

    def groups(self) -> np.ndarray:
        """Groups of each text."""
        return np.bincount(self.text_of(0)[self.ends[0]], minlength=len(self.first[0]) - 1)

    def written(self, store: Store) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        ends = [np.flatnonzero(e) + 1 for e in self.ends]
        group = [np.cumsum(e) - e for e in self.ends]
        # An A token stands behind the B tokens of the groups before, a B token behind the A tokens of its own too.
        place_a = np.arange(len(self.ids[0])) + np.append(0, ends[1])[group[0]]
        place_b = np.arange(len(self.ids[1])) + ends[0][group[1]]
        ids = np.empty(len(place_a) + len(place_b), np.int64)
        after = np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.ids[0], self.ids[1]
        after[place_a[self.ends[0]]], after[place_b[self.ends[1]]] = ord("|"), ord(";")
        digits, n = store.digits[ids], store.digits_n[ids]
        digits[np.arange(len(ids)), n] = after
        flat = digits[np.arange(digits.shape[1]) <= n[:, None]].tobytes()
        cut = np.append(0, np.cumsum(n + 1))[self.first[0] + self.first[1]].tolist()
        return [flat[p : max(p, q - 1)] for p, q in zip(cut, cut[1:], strict=False)]


def _store(a_path: str, b_path: str) -> Store:
    if (a_path, b_path) not in _stores:
        _stores.clear()
        _stores[a_path, b_path] = Store(a_path, b_path)
    return _stores[a_path, b_path]


def _lists(values: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, a_path: str, b_path: str, *, text: str = "text") -> DataFrame:
    """(row, a_ids, b_ids, groups, links) for every row of ``docs``; row has its other columns.

    The byte-level tokenizer at ``a_path`` encodes a space and the text, the
    piece model at ``b_path`` the text.  groups has for each the numbers of the A
    and the B token behind its last; links the token numbers (from 0) of each two
    that share bytes, by A, then B.  All are empty for null and empty texts and
    for texts that either tokenizer does not give back byte by byte.
    """
    others = [c for c in docs.columns if c != text]
    rows = docs.select((F.struct(*named(others)) if others else F.struct(F.lit(0).alias("none"))).alias("row"), *named([text], ["t"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(a_path, b_path)
        for batch in slices(batches, text=1, size=BATCH_BYTES):
            x = Aligned(store, batch.column(1).to_pylist())
            order = np.lexsort((x.link[1], x.link[0]))
            a, b = x.link[0][order], x.link[1][order]
            of = x.text_of(0)
            ends = [np.flatnonzero(e) for e in x.ends]
            pair = lambda a, b, own, names, x=x: pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(x.first[0]))), pa.int32()), pa.StructArray.from_arrays([pa.array(a - x.first[0][own], pa.int32()), pa.array(b - x.first[1][own], pa.int32())], names))
            yield pa.RecordBatch.from_pydict({
                "row": batch.column(0), "a_ids": _lists(x.ids[0], x.first[0], pa.int32()), "b_ids": _lists(x.ids[1], x.first[1], pa.int32()),
                "groups": pair(ends[0] + 1, ends[1] + 1, of[ends[0]], ["a_end", "b_end"]), "links": pair(a, b, of[a], ["a", "b"]),
            })

    rest = StructType.fromDDL("a_ids array<int>, b_ids array<int>, groups array<struct<a_end:int,b_end:int>>, links array<struct<a:int,b:int>>")
    return rows.mapInArrow(run, StructType([rows.schema["row"], *rest]))


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Distinct pairs in order and their times, compressed."""
    if not len(pairs):
        return b""
    steps = np.diff(pairs, prepend=0)
    wide = bool((steps >= 1 << 32).any() or (times >= 1 << 32).any())
    raw = np.concatenate((steps, times)).astype(np.uint64 if wide else np.uint32).tobytes()
    return bytes([wide]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True)
    both = np.frombuffer(raw, np.uint64 if data[0] else np.uint32).astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs to (pair, n): sums of what this task has read, or of as much as it holds."""
    held, size = [], 0

    def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
        pair, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return pair, np.bincount(where, np.concatenate([h[1] for h in held]), len(pair)).astype(np.int64)

    for batch in slices(batches):
        if rows := [_unpacked(x) for x in batch.column(0).to_pylist() if x]:
            held.append(summed(rows))
            size += len(held[-1][0])
        if size > HELD_PAIRS:
            held = [summed(held)]
            size = len(held[0][0])
            if size > HELD_PAIRS // 2:
                yield pa.RecordBatch.from_pydict({"pair": held[0][0], "n": held[0][1]})
                held, size = [], 0
    if held:
        pair, n = summed(held)
        yield pa.RecordBatch.from_pydict({"pair": pair, "n": n})


def digests(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    An id pair's count is the number of links, in all of ``docs``, that hold it.
    n_best: the links whose count is the largest that their B id has, ties
    included.  count_sum: of all links.  Texts without tokens (``aligned``) have
    zeros and an empty groups_sha256.  Repeated rows count as often as they
    stand.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(*named([id_col, text], ["id", "t"]))
    base = load_pieces(b_path).get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(a_path, b_path)
        for batch in slices(batches, rows=2000, text=1, size=BATCH_BYTES):
            x = Aligned(store, batch.column(1).to_pylist())
            pairs, times, cut, links = x.pairs(store.base)
            said = [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(store)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "n_a": np.diff(x.first[0]), "n_b": np.diff(x.first[1]), "n_groups": x.groups(), "n_links": links, "groups_sha256": said,
                "pairs": pa.array([_packed(pairs[p:q], times[p:q]) for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            })

    numbers = "n_a long, n_b long, n_groups long, n_links long"
    kept = durable(rows.mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL(f"{numbers}, groups_sha256 string, pairs binary")])))

    counts = durable(kept.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    of_b = F.col("pair") % base
    top = bounded(durable(counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))))
    counts = durable(counts.join(top, of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    whole = counts.limit(hot_pairs + 1).count() <= hot_pairs
    hot = (counts if whole else counts.orderBy(F.desc("n"), "pair").limit(hot_pairs)).toArrow().sort_by("pair").combine_chunks()
    hot = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(hot.column(c).to_numpy()) for c in ("pair", "n", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = hot.value
        for batch in slices(batches):
            sums, rest = [], []
            for data in batch.column("pairs").to_pylist():
                pair, times = _unpacked(data)
                at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
                there = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                at, t = at[there], times[there]
                sums.append((int(t[best[at]].sum()), int((t * n[at]).sum())))
                rest.append(_packed(pair[~there], times[~there]))
            out = {name: batch.column(name) for name in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            yield pa.RecordBatch.from_pydict(out | {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64()), "rest": pa.array(rest, pa.binary())})

    scored = kept.mapInArrow(score, StructType([*kept.drop("pairs").schema, *StructType.fromDDL("n_best long, count_sum long, rest binary")]))
    if not whole:
        scored = _with_rest(durable(scored.withColumn("row", F.monotonically_increasing_id())), counts)
    return scored.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_rest(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds what the links amount to whose pairs are not broadcast: they meet their counts by pair, and come back as one row a document."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=64):
            found = [_unpacked(x) for x in batch.column(1).to_pylist()]
            n = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_pydict({"row": np.repeat(batch.column(0).to_numpy(), n), "pair": np.concatenate([f[0] for f in found]), "times": np.concatenate([f[1] for f in found])})

    links = scored.select("row", "rest").where(F.octet_length("rest") > 0).mapInArrow(listed, "row long, pair long, times long")
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = scored.join(sums, "row", "left")
    more = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
