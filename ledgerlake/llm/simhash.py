"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it.  Fingerprints within ``radius`` differing bits are found in BK-trees, whose
children are keyed by their integer Hamming distance to the parent: a search
follows the edges d - radius .. d + radius only.

No tree of all fingerprints is built or broadcast, since its size has no bound.
Fingerprints are sharded by keys of which near ones share at least one, and
each shard's trees are built and searched in the task that holds the shard:

* ``exact_keys``: the bits are cut into radius + 2 parts.  Differing bits touch
  at most ``radius`` of them, so two parts agree, and each pair of parts is a
  key.  No link is lost.
* ``sampled_keys``: for wide radii, keys of sampled bits, as many as give the
  wanted chance that near fingerprints share one.

A shard over ``SHARD_CAP`` fingerprints is dealt out in blocks, and every pair
of blocks is searched by itself, so a crowded key loses nothing.

A task returns a minimum spanning forest of each tree's links, at most one link
fewer than the tree has members.  It connects what all the links connect, at
the given radius and at every smaller one.  Where links have to pass a check of
their own that is not enough: ``similar_groups`` then compares all texts that
hang together by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import ASCII_SPACE, bounded, bytes_of, compact, durable, named, runs_of, shuffle_partitions, slices
from ledgerlake.llm.graph import components

SEED = 42
SHARD_CAP = 4_096
#: Pairs that a search holds at once.
FRONTIER = 1 << 18
_LOW = np.uint64(0x0101010101010101)
_LOW52 = np.uint64((1 << 52) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words (A-Z lower-cased, space-joined), repeats included; fewer words: of them all."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    x = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([x(b" ".join(w), SEED)], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.array([len(k) + 1 for k in w])) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([x(joined[i:j], SEED) for i, j in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text (at most 4,096 texts), as sorted hashes of 52 bits, and where each text's start.

    Words and shingles as in ``shingle_hashes``; a shingle's hash is put together
    from those of its words, of which each one of the batch is hashed once.
    """
    data, cut = bytes_of(texts.fill_null("").cast(pa.string()))
    runs, of = runs_of(_LOWER[data], cut, ASCII_SPACE[data], pa.binary())
    runs = runs.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in runs.dictionary.to_pylist()], np.uint64)
    own = own[runs.indices.to_numpy()] if len(runs) else own
    n = np.diff(of)
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count - of[:-1], count)
    h = np.zeros(len(text), np.uint64)
    for k in range(words):
        inside = at + k < of[text + 1]
        h = np.where(inside, h * _ODD + own[np.minimum(at + k, len(own) - 1)], h) if len(own) else h
    h = np.sort((text.astype(np.uint64) << np.uint64(52)) | (mix(h, 1) >> np.uint64(12)))
    h = h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h
    return h & _LOW52, np.append(np.searchsorted(h, np.arange(len(n), dtype=np.uint64) << np.uint64(52)), len(h))


def majority_bits(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Of the hashes of each text (``cut`` as above) the 64 bits that over half of them have; none: zero.

    Bytes of all counters are summed together, at most 255 hashes at a time.
    """
    n = np.diff(cut)
    full = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if not len(full):
        return out
    parts = -(-n[full] // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(cut[:-1][full] - 255 * first, parts) + 255 * np.arange(parts.sum())
    counts = np.empty((len(full), 8, 8), np.int64)
    for bit in range(8):
        part = np.add.reduceat((h >> np.uint64(bit)) & _LOW, at).view(np.uint8).reshape(-1, 8)
        counts[:, :, bit] = np.add.reduceat(part, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * counts > n[full][:, None, None], axis=2, bitorder="little").reshape(-1, 8).view(np.uint64)[:, 0]
    return out


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (a 64-bit finalizer)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, *, id_col: str, text: str, words: int) -> DataFrame:
    """(id, f0) for every row: 64 bits of all shingles, repeats included, as a signed long.  No words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            h = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            bits = majority_bits(np.concatenate(h), np.cumsum([0, *map(len, h)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "f0"])

    rows = docs.select(*named([id_col, text], ["id", "t"]))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, f0 long")


def set_fingerprints(docs: DataFrame, *, id_col: str, text: str, words: int, lanes: int) -> DataFrame:
    """(id, f0 .. f{lanes-1}) for every row: 64 bits a lane of the set of its shingles, a repeated one counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000, text=1):
            h, cut = shingle_sets(batch.column(1), words)
            bits = [majority_bits(mix(h, 2 + k), cut).view(np.int64) for k in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, bits)], names=["id", *(f"f{k}" for k in range(lanes))])

    rows = docs.select(*named([id_col, text], ["id", "t"]))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"f{k} long" for k in range(lanes)))


# --- shards ---------------------------------------------------------------------------------


def exact_keys(radius: int, bits: int = 64) -> list[list[int]]:
    """Bit positions of each key: the pairs of radius + 2 parts."""
    parts = [list(map(int, p)) for p in np.array_split(np.arange(bits), radius + 2)]
    return [a + b for a, b in combinations(parts, 2)]


def miss_chance(width: int, count: int, *, agree: float, radius: int, bits: int) -> float:
    """Chance that fingerprints whose bits agree with chance ``agree`` differ in over ``radius`` bits or share none of ``count`` keys.

    All keys of a pair depend on the number of bits in which it differs: the miss is averaged over that.
    """
    miss = 0.0
    for d in range(bits + 1):
        chance = math.comb(bits, d) * (1 - agree) ** d * agree ** (bits - d)
        miss += chance * ((1 - math.comb(bits - d, width) / math.comb(bits, width)) ** count if d <= radius else 1.0)
    return miss


def sampled_keys(n: int, *, agree: float, recall: float, radius: int, bits: int, crowd: int = 64) -> list[list[int]]:
    """Keys of so many bits that about ``crowd`` of ``n`` random fingerprints share one, and as few keys as
    let fingerprints whose bits agree with chance ``agree`` meet with chance ``recall``."""
    width = max(8, math.ceil(math.log2(max(n, 1) / crowd)))
    count = 1
    while miss_chance(width, count, agree=agree, radius=radius, bits=bits) > 1 - recall:
        count += 1
    rng = np.random.default_rng(SEED)
    return [sorted(map(int, rng.choice(bits, width, replace=False))) for _ in range(count)]


def _key_columns(keys: list[list[int]]):
    """A key's number and the fingerprint's bits under its mask, hashed."""
    columns = []
    for k, positions in enumerate(keys):
        masked = [F.col(f"f{lane}").bitwiseAND(F.lit(sum(1 << (p % 64) for p in positions if p // 64 == lane) - (1 << 64) * (lane * 64 + 63 in positions))) for lane in sorted({p // 64 for p in positions})]
        columns.append(F.xxhash64(F.lit(k), *masked))
    return columns


# --- BK-trees -------------------------------------------------------------------------------


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Forest:
    """One BK-tree per group of ``group`` (sorted), as flat arrays.

    All trees grow a level a step: the first member of a group is its root, the
    others go to it together; of those with the same distance to a node the
    first becomes its child and the rest descend to that child.
    """

    def __init__(self, points: np.ndarray, group: np.ndarray):
        self.points, n = points, len(points)
        self.width = 64 * points.shape[1] + 1
        self.root = np.searchsorted(group, group, "left")
        keys, nodes = [], []
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]
        while len(waiting):
            edge = at * self.width + distance(points[waiting], points[at])
            unique, first, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(unique)
            nodes.append(waiting[first])
            at = waiting[first][back]
            rest = at != waiting
            waiting, at = waiting[rest], at[rest]
        edge = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], (np.concatenate(nodes) if nodes else edge)[order]

    def search(self, queries: np.ndarray, points: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) of all nodes within ``radius``, by parts; ``roots`` is the tree to search for each query."""
        stack = [(queries[i : i + FRONTIER], roots[i : i + FRONTIER]) for i in range(0, len(queries), FRONTIER)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[i : i + FRONTIER], node[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
                continue
            d = distance(points[q], self.points[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near], d[near]
            lo = np.searchsorted(self.edge, node * self.width + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * self.width + np.minimum(d + radius, self.width - 1), "right")
            n = hi - lo
            if n.sum():
                ends = np.cumsum(n)
                child = self.child[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo, n)]
                stack.append((np.repeat(q, n), child))


def spanning_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Indices of a minimum spanning forest (Kruskal; ties by a, then b)."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i in np.lexsort((b, a, d)).tolist():
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            parent[y] = x
            kept.append(i)
    return np.array(kept, np.int64)


def _found(points: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All links of each group, by parts.  side: 0 both in the tree and searched, 1 in the tree only, 2 searched only."""
    inside = np.flatnonzero(side != 2)
    tree_group = group[inside]
    forest = Forest(points[inside], tree_group)
    asked = np.flatnonzero(side != 1)
    at = np.searchsorted(tree_group, group[asked], "left")
    there = (at < len(tree_group)) & (tree_group[np.minimum(at, len(tree_group) - 1)] == group[asked]) if len(tree_group) else np.zeros(len(asked), bool)
    asked, at = asked[there], at[there]
    for q, node, dist in forest.search(asked, points, at, radius):
        found = inside[node]
        # A pair within one block is found from both ends; once is enough.
        once = (q < found) | ((side[q] == 2) & (q != found))
        if once.any():
            yield q[once], found[once], dist[once]


def _tree_links(points: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning links of each group, with sides as in ``_found``."""
    none = np.zeros(0, np.int64)
    a, b, d = none, none, none
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal a, b, d, fresh
        a, b, d = (np.concatenate(x) for x in zip((a, b, d), *fresh, strict=True))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        kept = spanning_forest(lo, hi, d, len(points))
        a, b, d, fresh = lo[kept], hi[kept], d[kept], []

    for link in _found(points, group, side, radius):
        fresh.append(link)
        if sum(len(x[0]) for x in fresh) > FRONTIER:
            fold()
    if fresh:
        fold()
    return a, b, d


def in_shards(rows: DataFrame, keys: list[list[int]], cols: list[str], cap: int) -> DataFrame:
    """(shard, side, k, *cols): ``rows`` (with f0 ..) once a key and block pair, whole shards sorted together; k is the key's number.

    A crowded key's members go in ``blocks`` by a hash of the row; a block is
    sent to each pair of blocks that it is in.  A pair (i, i) is searched in
    itself (side 0), a pair (i, j) holds i (side 1) and searches it for j (side 2).
    """
    spark = rows.sparkSession
    keyed = rows.select(*cols, F.posexplode(F.array(*_key_columns(keys))).alias("k", "key"))
    # Keys are counted by the bin of their hash first, so that a task reports few bins and not all of its keys.
    bins = 1 << max(10, (16 * rows.count() * len(keys) // cap).bit_length())
    binned = keyed.select("key", F.pmod("key", F.lit(bins)).alias("bin"))
    full = bounded(durable(binned.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("bin")))
    crowded = durable(binned.join(full, "bin", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("key", F.ceil(F.col("n") / cap).cast("long").alias("blocks")))
    # A key over the cap has more than ``cap`` rows, so there is at most one in ``cap`` rows, and so are there few full bins.
    dealt = keyed.join(bounded(crowded), "key", "left").withColumn("i", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(cols[0]), "blocks")))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least(F.col("i"), j).alias("x"), F.greatest(F.col("i"), j).alias("y")))
    )
    dealt = dealt.withColumn("p", F.explode(pairs))
    shard = F.xxhash64("key", "p.x", "p.y")
    side = F.when(F.col("p.x") == F.col("p.y"), 0).when(F.col("p.x") == F.col("i"), 1).otherwise(2).cast("int")
    dealt = dealt.select(shard.alias("shard"), side.alias("side"), "k", *cols)
    return dealt.repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), "shard").sortWithinPartitions("shard")


def key_masks(keys: list[list[int]], lanes: int) -> np.ndarray:
    """The keys' bits as unsigned longs (keys, lanes)."""
    return np.array([[sum(1 << (p % 64) for p in positions if p // 64 == lane) for lane in range(lanes)] for positions in keys], np.uint64)


def first_shared(differ: np.ndarray, k: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether key ``k`` is the first that a pair shares, from the pair's differing bits: a pair that meets in several keys is then given once."""
    first = np.ones(len(k), bool)
    for n, mask in enumerate(masks[: int(k.max(initial=0))]):
        ask = np.flatnonzero(first & (k > n))
        first[ask] = (differ[ask] & mask).any(axis=1)
    return first


def near_links(prints: DataFrame, keys: list[list[int]], radius: int, *, lanes: int = 1) -> DataFrame:
    """Links (a, b, d) between ``prints`` (node long, f0 ..; one row a fingerprint) that connect all within ``radius``."""
    cols = [f"f{k}" for k in range(lanes)]
    rows = in_shards(prints, keys, ["node", *cols], SHARD_CAP).drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            group, side, node = (table.column(k).to_numpy() for k in range(3))
            points = np.stack([table.column(3 + k).to_numpy() for k in range(lanes)], axis=1).view(np.uint64)
            # Alone in its shard: nothing to find.
            _, back, n = np.unique(group, return_inverse=True, return_counts=True)
            many = n[back] > 1
            group, side, node, points = group[many], side[many], node[many], points[many]
            a, b, d = _tree_links(points, group, side, radius) if len(group) else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(d.astype(np.int32))], names=["a", "b", "d"])

    return rows.mapInArrow(run, "a long, b long, d int")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows in which no run of the first column is cut."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


# --- near-duplicates ------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits, and a component is
    what links reach; its id is the smallest doc_id in it.  Null and empty texts
    have the fingerprint zero, linked like any other.  Equal fingerprints are
    one node of the search, so copies cost nothing.  A null id is never the
    smallest; a component of null ids only has a null id.
    """
    prints = durable(fingerprints(docs, id_col=id_col, text=text, words=words))
    nodes = durable(prints.groupBy("f0").agg(F.min("id").alias("least")))
    links = near_links(nodes.select(F.col("f0").alias("node"), "f0"), exact_keys(radius), radius)
    roots = components(links)
    # The smallest id of each component: first over its fingerprints, then back to them.
    joined = durable(nodes.join(roots, nodes.f0 == roots.node, "left").select("f0", "least", F.coalesce("root", "f0").alias("root")))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "root").select("f0", "component_id")
    out = prints.join(named, "f0")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by shingle similarity --------------------------------------------------

LANES = 4
#: Texts of a block that are compared at once, and hashes that a comparison holds as columns.
BLOCK_TEXTS = 512
COLUMNS = 8_192


def bit_agreement(similarity: float) -> float:
    """Chance that a bit agrees for two texts of equal length with this Jaccard similarity: the angle between their sums decides."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def _jaccard(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, 1_000, text=2), 1_000, text=3):
            (x, at), (y, bt) = (shingle_sets(batch.column(k), words) for k in (2, 3))
            # Both sides' sets of a row together: what stands there twice is shared.
            row = [np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(cut)) << np.uint64(52) for cut in (at, bt)]
            both = np.sort(np.concatenate((x | row[0], y | row[1])))
            twice = both[1:][both[1:] == both[:-1]] >> np.uint64(52)
            shared = np.bincount(twice.astype(np.int64), minlength=batch.num_rows)
            total = np.diff(at) + np.diff(bt) - shared
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared / np.maximum(total, 1))], names=["a", "b", "similarity"])

    return run


def shared_counts(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many hashes each two sets (as from ``shingle_sets``) share."""
    row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    _, name, times = np.unique(h, return_inverse=True, return_counts=True)
    # A hash that only one set has is shared by none.
    many = times[name] > 1
    row, name = row[many], (np.cumsum(times > 1) - 1)[name[many]]
    out = np.zeros((len(cut) - 1,) * 2, np.float32)
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    for lo in range(0, int(name[-1]) + 1 if len(name) else 0, COLUMNS):
        i, j = np.searchsorted(name, [lo, lo + COLUMNS])
        has = np.zeros((len(cut) - 1, COLUMNS), np.float32)
        has[row[i:j], name[i:j] - lo] = 1
        out += has @ has.T
    return out


def _block_links(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that span all pairs of ``members`` (node, t, part, crowd) of one crowd but different parts that are similar.

    A crowd is dealt in blocks and each pair of blocks compared in one task, so
    its pairs are looked at and not written: at most one link a member and block
    pair comes out.  The time still grows with the square of a crowd.
    """
    spark = members.sparkSession
    sizes = compact(members.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("long").alias("blocks")))
    rows = members.join(bounded(sizes), "crowd").withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("crowd", F.least("i", "j"), F.greatest("i", "j")).alias("shard"), "node", "part", "t")
    rows = rows.repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(slices(batches, text=3), 2 * BLOCK_TEXTS):
            shard = table.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                node, part = (table.column(k).to_numpy()[lo:hi] for k in (1, 2))
                sets = [shingle_sets(table.column(3).slice(at, min(2_000, hi - at)).combine_chunks(), words) for at in range(lo, hi, 2_000)]
                cut = np.concatenate(([0], *(c[1:] + sum(len(x[0]) for x in sets[:k]) for k, (_, c) in enumerate(sets))))
                both = shared_counts(np.concatenate([h for h, _ in sets]), cut)
                n = np.diff(cut).astype(np.float32)
                like = both / np.maximum(n[:, None] + n - both, 1)
                a, b = np.nonzero(np.triu((like >= similarity) & (part[:, None] != part), 1))
                kept = spanning_forest(a, b, 1 - like[a, b], hi - lo)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a[kept]]), pa.array(node[b[kept]])], names=["a", "b"])

    return compact(rows.mapInArrow(run, "a long, b long"))


def similar_groups(docs: DataFrame, *, text: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """(t1, t2, root) of every distinct text of ``docs``: its 128-bit hash, and its group's root.

    Candidates are the BK-tree links of 256-bit fingerprints at a radius that texts
    of this similarity exceed once in thousands; an exact Jaccard check of their
    shingle sets follows, and where it parts what such links hold together, one of
    all pairs across the parts.  Both take a
    shingle that a text repeats once.  ``recall`` is the chance that two texts of just this
    similarity meet, whatever the number of texts; nearer ones meet more surely.
    """
    body = F.coalesce(*named([text]), F.lit(""))
    hashed = docs.select(F.struct(F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(7), body).alias("t2")).alias("k"), body.alias("t"))
    rows = set_fingerprints(hashed, id_col="k", text="t", words=words, lanes=LANES)
    lanes = [f"f{k}" for k in range(LANES)]
    distinct = rows.groupBy(F.col("id.t1").alias("t1"), F.col("id.t2").alias("t2")).agg(*(F.first(c).alias(c) for c in lanes))
    # Numbered once and kept, so the numbers stay.
    prints = durable(distinct.withColumn("node", F.monotonically_increasing_id()))
    agree, bits = bit_agreement(similarity), 64 * LANES
    radius = math.ceil(bits * (1 - agree) + 3.5 * math.sqrt(bits * agree * (1 - agree)))
    keys = sampled_keys(prints.count(), agree=agree, recall=recall, radius=radius, bits=bits)

    def texts_of(asked: DataFrame) -> DataFrame:
        """(node, t) for ``asked`` (node, t1, t2)."""
        return hashed.select("k.t1", "k.t2", "t").join(bounded(asked.select("node", "t1", "t2")), ["t1", "t2"]).groupBy("node").agg(F.first("t").alias("t"))

    def checked(pairs: DataFrame) -> DataFrame:
        """(a, b, ok); only the texts of candidates are fetched, one of each."""
        texts = durable(texts_of(compact(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(prints.select("node", "t1", "t2"), "node"))))
        sides = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("s")), "a").join(texts.select(F.col("node").alias("b"), "t"), "b").select("a", "b", "s", "t")
        return compact(sides.mapInArrow(_jaccard(words), "a long, b long, similarity double").select("a", "b", (F.col("similarity") >= similarity).alias("ok")))

    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """``pairs`` with the parts pa and pb of their ends, where these differ; what is in no part is one by itself."""
        for side in ("a", "b"):
            at = parts.select(F.col("node").alias(side), F.col("root").alias(f"p{side}"))
            pairs = pairs.join(at, side, "left").withColumn(f"p{side}", F.coalesce(f"p{side}", side))
        return pairs.where("pa <> pb")

    found = near_links(prints.select("node", *lanes), keys, radius, lanes=LANES)
    found = compact(found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d")))
    # First each text's nearest link; most of a group hangs together by those.
    ends = found.select(F.col("a").alias("u"), F.struct("d", "a", "b").alias("link")).unionByName(found.select(F.col("b").alias("u"), F.struct("d", "a", "b").alias("link")))
    tested = checked(ends.groupBy("u").agg(F.min("link").alias("link")).select("link.a", "link.b").distinct())
    parts = components(tested.where("ok"))
    # Then the other links between what is not connected yet.
    rest = compact(apart(found.select("a", "b").join(tested, ["a", "b"], "left_anti"), parts).select("a", "b"))
    if not rest.isEmpty():
        tested = tested.unionByName(checked(rest))
        parts = components(tested.where("ok"))
    # The trees' links span what is within the radius, but similarity does not follow the differing bits exactly: where
    # such a link did not pass, all pairs across the parts on its two sides are compared, in blocks.
    open_ = compact(apart(tested.where("NOT ok"), parts).select(F.explode(F.array("pa", "pb")).alias("part")).distinct())
    if not open_.isEmpty():
        near = components(found).withColumnRenamed("root", "crowd")
        members = prints.select("node", "t1", "t2").join(parts, "node", "left").select("node", "t1", "t2", F.coalesce("root", "node").alias("part"))
        members = compact(members.join(open_, "part").join(near, "node").select("node", "part", "crowd", "t1", "t2"))
        held = durable(texts_of(members).join(members.select("node", "part", "crowd"), "node"))
        parts = components(tested.where("ok").select("a", "b").unionByName(_block_links(held, words, similarity)))
    return prints.select("t1", "t2", "node").join(parts, "node", "left").select("t1", "t2", F.coalesce("root", "node").alias("root"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates: the one with the smallest id (a null id is last).

    Equal texts are always one group, null and empty ones too.  Of rows that
    share text and id, one stays, by a hash of the row.
    """
    body = F.coalesce(*named([text]), F.lit(""))
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), *named([id_col], ["id"]), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(7), body).alias("t2"), F.xxhash64(*named(docs.columns)).alias("h"))
    groups = durable(similar_groups(docs, text=text, words=words, similarity=similarity))
    first = rows.groupBy("t1", "t2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m"))
    first = first.join(groups, ["t1", "t2"]).groupBy("root").agg(F.min(F.struct("m", "t1", "t2")).alias("best"))
    stay = first.select(F.col("best.t1").alias("t1"), F.col("best.t2").alias("t2"), F.col("best.m.h").alias("h"))
    kept = rows.join(stay, ["t1", "t2", "h"], "left_semi").dropDuplicates(["t1", "t2", "h"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
