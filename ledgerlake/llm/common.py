"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, and the runs between them.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir`` (``shared_folder``).
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Rows (of a few numbers each) that a task takes of a table whose partitions follow its size.
ROWS_A_TASK = 250_000


def compact(df: DataFrame) -> DataFrame:
    """``durable`` for a table of some numbers a row, in as many partitions as its counted rows need, so that steps over few rows are few tasks and files."""
    kept = durable(df)
    return kept.coalesce(max(1, math.ceil(kept.count() / ROWS_A_TASK)))


#: Rows (of a few numbers each) up to which a counted table is broadcast.
BROADCAST_ROWS = 500_000


def bounded(few: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``few``, a kept table of some numbers a row, marked for broadcast if it has at most ``rows`` rows; else left to a shuffle."""
    return F.broadcast(few) if few.limit(rows + 1).count() <= rows else few


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a single machine may have none set: it gets a temporary one."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` does the same on pure ASCII and is far cheaper than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 8 << 20, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Spark's batches in small parts, so that a worker holds few texts and results as Python objects at a time.

    With ``text``, the number of a string column, a part has at most ``size`` bytes of it, or one row.
    """
    for batch in batches:
        at = 0
        ends = None if text is None else np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            if ends is not None:
                n = max(1, min(n, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")) - at))
            yield batch.slice(at, n)
            at += n


def named(names: list[str], to: list[str] | None = None) -> list[Column]:
    """Columns by their whole names, dots and back-ticks included, as ``to``."""
    return [F.col("`" + n.replace("`", "``") + "`").alias(t) for n, t in zip(names, to or names, strict=True)]


# --- texts as Arrow buffers -----------------------------------------------------------------

ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and where each value starts (one more than values)."""
    cut = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8)[cut[0] : cut[-1]] if data is not None else np.zeros(0, np.uint8)), cut - cut[0]


def values_of(data: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The array that ``bytes_of`` takes apart."""
    return pa.Array.from_buffers(kind, len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def runs_of(data: np.ndarray, cut: np.ndarray, space: np.ndarray, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """The runs of bytes between those marked in ``space``, and where each text's runs start."""
    fresh = np.ones(len(data), bool)
    fresh[1:] = space[:-1]
    fresh[cut[:-1][cut[:-1] < len(data)]] = True
    keep = ~space
    starts = np.flatnonzero(fresh & keep)
    kept = np.concatenate(([0], np.cumsum(keep)))
    return values_of(data[keep], np.append(kept[starts], kept[-1]), kind), np.searchsorted(starts, cut)
