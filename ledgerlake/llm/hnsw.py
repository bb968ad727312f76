"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id.  Each shard's graph is built
in one task and kept as flat arrays: the vectors, one matrix of neighbour
positions for the bottom layer and a smaller one for each layer above it.
Query blocks visit every shard's graph; the shard results are merged by score.
No shard is skipped: where neighbours are spread over all directions, as in
the given vectors, half of all shards would have to be asked to find nine in
ten of them, and a coarse routing would lose the rest.

Insertion and search run on whole batches: every row of a batch has its own
beam, and one step expands the best open candidates of all beams at once.
Nodes of the same batch see each other by direct comparison, so a batch is as
good as inserting one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable, named

#: Vectors of a shard on average, what a task builds and holds: as many as keep all tasks busy, between these bounds.
#: A search costs little more in a large graph than in a small one, so few large shards are cheaper than many small ones.
SHARD_ROWS = (4_096, 16_384)
#: Queries that meet a shard in one go, and that a search holds at once.
QUERY_BLOCK = 8_192
LINKS = 16
BEAM_BUILD = 80
BEAM_SEARCH = 128
OPEN = 4  # candidates that each beam expands in a step
BATCH = 256


def _squared(v: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to its row of ids (-1: infinity), from differences, so that near ones stay apart."""
    apart = v[ids]
    apart -= q[:, None]
    return np.where(ids < 0, np.float32(np.inf), np.einsum("bkd,bkd->bk", apart, apart))


def _distance(nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double; where squares would leave the range of doubles, of parts of the largest difference."""
    with np.errstate(over="ignore", under="ignore"):
        apart = nodes - q
        d = np.sqrt((apart**2).sum(axis=1))
    most = np.abs(apart).max(axis=1, initial=0)
    odd = (most > 1e150) | ((most > 0) & (most < 1e-150))
    if odd.any():
        d[odd] = most[odd] * np.sqrt(((apart[odd] / most[odd, None]) ** 2).sum(axis=1))
    return d


class Graph:
    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        # Single precision holds only what is left of the vectors about their mean, as a share of the largest part of it.
        self.size = float(np.abs(vectors).max(initial=0)) or 1.0
        part = vectors / self.size
        self.centre = part.mean(axis=0)
        part -= self.centre
        self.spread = float(np.abs(part).max(initial=0)) or 1.0
        self.v = np.ascontiguousarray(part / self.spread, np.float32)
        self.links = links
        #: For each layer: a row for each of its nodes, and each node's row (-1: not in the layer).
        self.layers: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, beam: int = BEAM_BUILD) -> Graph:
        g, n = cls(vectors, links), len(vectors)
        draws = np.random.default_rng(n).random(n)
        level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(links)).astype(int), 8)
        level[0] = level.max(initial=0)  # the first node is in all layers, so it stays the entry
        for layer in range(int(level[0]) + 1):
            members = np.flatnonzero(level >= layer)
            g.rows.append(np.full(n, -1, np.int32))
            g.rows[-1][members] = np.arange(len(members))
            g.layers.append(np.full((len(members), links * (1 if layer else 2)), -1, np.int32))
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(BATCH, done)))
            g._insert(new, level[new], beam)
            done += len(new)
        return g

    def _insert(self, new: np.ndarray, level: np.ndarray, beam: int) -> None:
        q = self.v[new]
        at = np.zeros((len(new), 1), np.int32)
        for layer in range(len(self.layers) - 1, -1, -1):
            found, d = self._beam(q, at, layer, beam if layer == 0 else beam // 4)
            at = found[:, : max(1, beam // 8)]
            own = np.flatnonzero(level >= layer)
            if not len(own):
                continue
            # The others of this batch that enter the layer too.
            mates = np.broadcast_to(new[own], (len(own), len(own))).astype(np.int32)
            apart = _squared(self.v, q[own], mates)
            np.fill_diagonal(apart, np.inf)
            near = np.argsort(apart, axis=1, kind="stable")[:, : self.links * 2]
            ids = np.concatenate((found[own], np.take_along_axis(mates, near, 1)), axis=1)
            dist = np.concatenate((d[own], np.take_along_axis(apart, near, 1)), axis=1)
            picked = self._diverse(q[own], np.where(np.isinf(dist), -1, ids), dist, self.links)
            self.layers[layer][self.rows[layer][new[own]], : self.links] = picked
            self._link_back(layer, new[own], picked)

    def _link_back(self, layer: int, nodes: np.ndarray, picked: np.ndarray) -> None:
        to, source = picked.ravel(), np.repeat(nodes, picked.shape[1]).astype(np.int32)
        order = np.argsort(to, kind="stable")
        order = order[to[order] >= 0]
        to, source = to[order], source[order]
        target, start, count = np.unique(to, return_index=True, return_counts=True)
        adj, rows, width = self.layers[layer], self.rows[layer][target], self.layers[layer].shape[1]
        for part in np.array_split(np.arange(len(target)), max(1, len(target) // 512)):
            more = np.full((len(part), int(count[part].max(initial=0))), -1, np.int32)
            for k in range(more.shape[1]):
                has = count[part] > k
                more[has, k] = source[start[part][has] + k]
            ids = np.concatenate((adj[rows[part]], more), axis=1)
            ids = np.sort(ids, axis=1)[:, ::-1]  # -1 last
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1  # linked both ways already
            full = (ids >= 0).sum(1) > width
            dist = _squared(self.v, self.v[target[part]], ids)
            order = np.argsort(dist, axis=1, kind="stable")
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            out = np.full((len(part), width), -1, np.int32)
            w = min(width, ids.shape[1])
            out[:, :w] = ids[:, :w]
            if full.any():
                out[full] = self._diverse(self.v[target[part[full]]], ids[full], dist[full], width)
            adj[rows[part]] = out

    def _diverse(self, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
        """m of ids a row: nearest first, those nearer to a picked one than to the node only where places are left."""
        order = np.argsort(dist, axis=1, kind="stable")[:, : 4 * m]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        v = self.v[ids] - nodes[:, None]
        norms = np.einsum("bkd,bkd->bk", v, v)
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        n, c = ids.shape
        picked = np.zeros((n, c), bool)
        total = np.zeros(n, int)
        for k in range(c):
            clear = ~((between[:, k, :] < dist[:, k, None]) & picked).any(1)
            take = clear & (ids[:, k] >= 0) & (total < m)
            picked[:, k], total = take, total + take
        rank = np.where(ids < 0, 2 * c + 1, np.where(picked, 0, c) + np.arange(c))
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(ids, order, 1)
        return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes of a layer that each beam comes upon, nearest first (-1 and infinity past the last)."""
        adj, rows = self.layers[layer], self.rows[layer]
        b, n = len(q), len(self.v)
        ids = np.full((b, width), -1, np.int32)
        dist = np.full((b, width), np.inf, np.float32)
        start = start[:, :width]
        ids[:, : start.shape[1]] = start
        dist[:, : start.shape[1]] = _squared(self.v, q, start)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        closed = ids < 0
        seen = np.zeros((b, n + 1), bool)
        seen[np.arange(b)[:, None], start] = True
        seen[:, n] = seen[:, -1] = True  # position -1 is never new
        live = np.arange(b)
        while len(live):
            open_ = ~closed[live]
            rank = np.cumsum(open_, axis=1)
            now = open_ & (rank <= OPEN)
            closed[live] |= now
            # The positions to expand, OPEN a row; rows with fewer repeat their last column as -1.
            take = np.argsort(~now, axis=1, kind="stable")[:, :OPEN]
            nodes = np.where(np.take_along_axis(now, take, 1), np.take_along_axis(ids[live], take, 1), -1)
            next_ = np.where(nodes[:, :, None] >= 0, adj[rows[nodes]], -1).reshape(len(live), -1)
            next_ = np.sort(next_, axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_ = np.where(seen[live[:, None], next_], -1, next_)
            seen[live[:, None], next_] = True
            d = _squared(self.v, q[live], next_)
            all_ids, all_d = np.concatenate((ids[live], next_), axis=1), np.concatenate((dist[live], d), axis=1)
            all_closed = np.concatenate((closed[live], next_ < 0), axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            ids[live], dist[live], closed[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_d, all_closed))
            live = live[~closed[live].all(1)]
        return ids, dist

    def search(self, q: np.ndarray, beam: int = BEAM_SEARCH) -> np.ndarray:
        """Positions of the nodes that each query's beam ends with (-1 past the last)."""
        near = []
        for lo in range(0, len(q), BATCH):
            part = np.ascontiguousarray(np.clip((q[lo : lo + BATCH] / self.size - self.centre) / self.spread, -1e15, 1e15), np.float32)
            at = np.zeros((len(part), 1), np.int32)
            for layer in range(len(self.layers) - 1, 0, -1):
                at = self._beam(part, at, layer, 16)[0]
            near.append(self._beam(part, at, 0, beam)[0])
        return np.concatenate(near)

    def flat(self) -> dict[str, bytes | list[int]]:
        return {"widths": [x.shape[1] for x in self.layers], "sizes": [len(x) for x in self.layers], "neighbours": b"".join(x.tobytes() for x in self.layers), "members": b"".join(np.flatnonzero(r >= 0).astype(np.int32).tobytes() for r in self.rows)}

    @classmethod
    def from_flat(cls, vectors: np.ndarray, widths, sizes, neighbours: bytes, members: bytes) -> Graph:
        g, a, m = cls(vectors), 0, 0
        flat, who = np.frombuffer(neighbours, np.int32), np.frombuffer(members, np.int32)
        for w, s in zip(widths, sizes, strict=True):
            g.layers.append(flat[a : a + w * s].reshape(s, w))
            g.rows.append(np.full(len(vectors), -1, np.int32))
            g.rows[-1][who[m : m + s]] = np.arange(s)
            a, m = a + w * s, m + s
        return g


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: a shard's graph.  A node is a distinct vector with its ids in order."""
    v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    ids = pdf["id"].to_numpy(np.int64)
    nodes, back = np.unique(v, axis=0, return_inverse=True)
    # np.unique sorts; a seeded shuffle spreads neighbours over the batches.
    shuffle = np.random.default_rng(len(nodes)).permutation(len(nodes))
    place = np.empty_like(shuffle)
    place[shuffle] = np.arange(len(nodes))
    nodes, owner = nodes[shuffle], place[back.ravel()]
    order = np.lexsort((ids, owner))
    starts = np.searchsorted(owner[order], np.arange(len(nodes) + 1))
    # float32 vectors lose nothing where the column is float32; scores are taken in double from these.
    row = {"shard": pdf["shard"].iloc[0], "dim": pdf["dim"].iloc[0], "ids": ids[order], "starts": starts, "vectors": nodes.tobytes()}
    return pd.DataFrame([row | Graph.build(nodes).flat()])


INDEX = "shard long, dim int, ids array<long>, starts array<long>, vectors binary, widths array<int>, sizes array<int>, neighbours binary, members binary"


def build_index(rows: DataFrame, *, shard_rows: int | None = None) -> DataFrame:
    """One row a shard, from ``rows`` (id, v).  Vectors of another length are in shards of their own.

    Of rows that share an id the smallest vector counts, whatever their number.
    """
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = rows.count()
    if shard_rows is None:
        shard_rows = min(max(SHARD_ROWS[0], -(-n // rows.sparkSession.sparkContext.defaultParallelism)), SHARD_ROWS[1])
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // shard_rows)))))
    return dealt.select("shard", "dim", "id", "v").groupBy("shard", "dim").applyInPandas(_index_shard, INDEX)


def _search_shards(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for x in batch.to_pylist():
                nodes = np.frombuffer(x["vectors"], np.float64).reshape(-1, x["dim"])
                graph = Graph.from_flat(nodes, x["widths"], x["sizes"], x["neighbours"], x["members"])
                ids, starts = np.array(x["ids"]), np.array(x["starts"])
                queries = np.array(x["qv"], np.float64)
                for q_id, q, found in zip(x["q_ids"], queries, graph.search(queries, beam), strict=True):
                    found = found[found >= 0]
                    score = _distance(nodes[found], q)
                    # A node's first k + 1 ids are enough: one of them may be the query's own.
                    n = np.minimum(starts[found + 1] - starts[found], k + 1)
                    at = np.repeat(starts[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    near, score = ids[at], np.repeat(score, n)
                    near, score = near[near != q_id], score[near != q_id]
                    best = np.lexsort((near, score))[:k]
                    out.append((np.full(len(best), q_id, np.int64), near[best], score[best]))
            if out:
                q, near, score = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None, beam: int = BEAM_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest vectors, its own id excepted.

    Score is the Euclidean distance in double precision, ties go to the smaller
    id.  Vectors that are null, zero or have null or non-finite components, and
    rows without an id, take no part on either side; of rows that share an id
    the smallest vector counts.  Vectors of unlike lengths are not compared.
    Fewer candidates than ``k``: all that are found.  Other columns are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(*named([id_col, vector], ["id", "v"])).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & usable(F.col("v")))

    index = durable(build_index(clean(vectors), shard_rows=shard_rows))
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    blocks = blocks.select(F.col("dim").alias("d"), F.col("q.id").alias("q_ids"), F.col("q.v").alias("qv"))
    # Every block of a bounded number of queries meets every shard of its dimension.
    met = blocks.join(index.select("shard", "dim"), F.col("d") == F.col("dim")).select(F.col("shard").alias("s"), "d", "q_ids", "qv")
    pairs = index.join(met, (F.col("shard") == F.col("s")) & (F.col("dim") == F.col("d"))).drop("s", "d")
    found = pairs.mapInArrow(_search_shards(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
