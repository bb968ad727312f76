"""A counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings (insults are
inflected and compounded).  For every labelled text that
names a group of people, a copy is made with its identity terms swapped for
others of the same kind; the squared change of the score between the two is
added to the loss.  A term that stands in many insults then can't carry weight
of its own, so neutral mentions of a group stay neutral.

Only the fit works on a sample, of at most ``max_labelled`` labelled rows; the
word statistics, the feature rows and all scores are made on the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable, named, slices

#: Interchangeable identity terms, by kind; lower case, one word each.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "african", "latino", "arab", "european", "american"),
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("trans", "transgender", "cisgender"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("juden", "muslime", "christen", "hindus"), ("frauen", "männer"), ("schwule", "lesben"), ("türken", "deutsche", "polen"),
    ("juifs", "musulmans", "chrétiens"), ("femmes", "hommes"), ("arabes", "français", "africains"),
    ("judíos", "musulmanes", "cristianos"), ("mujeres", "hombres"), ("gitanos", "españoles", "árabes"),
)
MAX_LABELLED = 12_000
FEATURES = 512
SPARSITY = 0.5
FAIRNESS = 4.0

_words = re.compile(r"[^\W\d_]+").findall


PREFIXES = (4, 5, 6, 7, 8)


def words(text: str | None) -> set[str]:
    return set(_words(text.lower())) if text else set()


def features_of(have: set[str], prefixes: tuple[int, ...] = PREFIXES) -> set[str]:
    """Words, and the beginnings of longer words with a mark behind."""
    return have.union(*({w[:k] + "*" for w in have if len(w) > k} for k in prefixes))


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each term's stand-in: the next one of its kind."""
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by 5.  False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """``weights``: of the features; a text's score takes each feature once."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.prefixes = tuple(sorted({len(f) - 1 for f in weights if f.endswith("*")}))

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.weights.keys() & features_of(words(text), self.prefixes))))
        return float(1 / (1 + math.exp(-min(40.0, max(-40.0, z)))))


def _solve(x: np.ndarray, y: np.ndarray, change: np.ndarray, sparsity: float, fairness: float, rounds: int = 8, steps: int = 25) -> tuple[float, np.ndarray]:
    """Newton's method for the logistic loss + sparsity |w|_1 + fairness |change w|^2 / 2.

    The first norm is reached by reweighted squares.  It matters where copies
    of one text stand in the sample: their words all say the same, and words
    that other texts bear out take their place.
    """
    x = np.hstack([np.ones((len(x), 1), np.float32), x])
    fair = np.zeros((x.shape[1], x.shape[1]))
    fair[1:, 1:] = fairness * (change.T @ change).astype(float)
    w = np.zeros(x.shape[1])
    for k in range(rounds):
        weight = np.full(len(w), sparsity) if not k else sparsity / (np.abs(w) + 0.02)
        weight[0] = 1e-3
        penalty = fair + np.diag(weight)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - y) + penalty @ w
            curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + penalty
            step = np.linalg.solve(curve, slope)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
    w[1:][np.abs(w[1:]) < 0.02] = 0
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, features: int = FEATURES, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, sparsity: float = SPARSITY, fairness: float = FAIRNESS) -> Model:
    """Fit on the labelled rows that are not held out; of more than ``max_labelled``, those with the smallest hash of their id.

    Rows without an id or a label are left out, of several labels of one id, or of
    one text, the larger counts.  Where a class is missing the model is the smoothed share of
    the other one.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # At most max_labelled pairs of numbers: under a megabyte at the default.
    sample = docs.select(*named([id_col, text], ["id", "t"])).join(F.broadcast(known), "id").select("y", "t")
    # Copies of a text bear witness once, with the larger label where they differ.
    sample = sample.groupBy("t").agg(F.max("y").alias("y")).select("y", "t")
    sample = durable(sample.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(features_of(words(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["y", "w"])

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model(float(np.log((pos + 0.5) / (neg + 0.5))), {})
    seen = sample.mapInArrow(listed, "y int, w array<string>").select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= 2)
    seen = durable(seen)
    # The G statistic of each word's table; what the strongest of so many words would reach by chance is left out.
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def cell(n: Column, row: Column, column: int) -> Column:
        return F.when(n > 0, n * F.log(n * (pos + neg) / (row * column))).otherwise(F.lit(0.0))

    rest = pos + neg - a - b
    g = 2 * (cell(a, a + b, pos) + cell(b, a + b, neg) + cell(pos - a, rest, pos) + cell(neg - b, rest, neg))
    chance = 2 * np.log(max(seen.count(), 2)) + 2
    ranked = seen.withColumn("g", g).where(F.col("g") >= float(chance)).orderBy(F.desc("g"), "w")
    picked = [r["w"] for r in ranked.limit(features).collect()]
    stand_in = swaps(groups)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys([*picked, *stand_in]))}

    def cells(have: set[str]) -> bytes:
        return np.array(sorted(vocabulary[f] for f in features_of(have) & vocabulary.keys()), np.uint16).tobytes()

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each text, and those of its copy with swapped terms where it has any."""
        for batch in slices(batches):
            plain, swapped = [], []
            for t in batch.column(1).to_pylist():
                have = words(t)
                named = have & stand_in.keys()
                plain.append(cells(have))
                swapped.append(cells((have - named) | {stand_in[w] for w in named}) if named else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary()), pa.array(swapped, pa.binary())], names=["y", "plain", "swapped"])

    rows = sorted(map(tuple, sample.mapInArrow(positions, "y int, plain binary, swapped binary").collect()), key=lambda r: (r[0], bytes(r[1]), bytes(r[2] or b"")))

    def matrix(rows_: list[bytes]) -> np.ndarray:
        x = np.zeros((len(rows_), len(vocabulary)), np.float32)
        for i, c in enumerate(rows_):
            x[i, np.frombuffer(c, np.uint16)] = 1
        return x

    both = [r for r in rows if r[2] is not None]
    change = matrix([r[1] for r in both]) - matrix([r[2] for r in both])
    bias, w = _solve(matrix([r[1] for r in rows]), np.array([r[0] for r in rows], float), change, sparsity, fairness)
    return Model(bias, {k: float(w[i]) for k, i in vocabulary.items() if abs(w[i]) > 1e-9})


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, from the whole text only.

    Null and empty texts get the model's base score.  Rows are scored one by
    one, so repeated rows get a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    rows = docs.select(*named([id_col, text], ["id", "t"]))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they are."""

    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
