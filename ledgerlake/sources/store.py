"""Tables in parts that are replaced together, by one small file.

A store is a folder: ``data`` has what each commit wrote, in folders that never
change, and ``manifests`` a numbered file a commit, which says for each table
which folder each of its parts is in.  A commit writes the parts that it touches,
then its manifest, under a name that nothing had before.  Readers take the
manifest with the highest number, so they see a commit whole or not at all, and a
job lost at any point leaves the last commit in place.  One writer at a time.

A part is a bucket of keys (``merge_by_key``) or a scope of column values
(``replace_scopes``); the files of all other parts stay as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Manifests that stay, so that readers of the last few commits can finish.
KEPT = 3
_PART = "_part"
_NONE = {"seq": 0, "tables": {}, "batches": {}}


def _at(spark: SparkSession, path: str):
    """The path and its file system, as the session's Hadoop configuration has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(name[:-5]) for name in _listed(spark, f"{path}/manifests") if name.endswith(".json") and name[:-5].isdigit()]


def _manifest(spark: SparkSession, path: str, seq: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifests/{seq:012d}.json", wholetext=True).first()[0])


def latest(spark: SparkSession, path: str) -> dict:
    """The last commit: seq, tables (schema, parts) and the last batch of each writer."""
    known = _numbers(spark, path)
    return _manifest(spark, path, max(known)) if known else _NONE


def read_table(spark: SparkSession, path: str, table: str = "rows", parts: list[str] | None = None, manifest: dict | None = None) -> DataFrame | None:
    """A table as of the last commit (or ``manifest``), or only some of its parts; None where there is no such table yet."""
    known = (manifest or latest(spark, path))["tables"].get(table)
    if known is None:
        return None
    schema = StructType.fromJson(known["schema"])
    folders = [f"{path}/{known['parts'][p]}" for p in (known["parts"] if parts is None else parts) if p in known["parts"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_parts(df: DataFrame, path: str) -> dict[str, str]:
    """Writes rows by their part; the parts' folders, relative to the store.  A large part is several files."""
    spark, version = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{path}/{version}")
    return {name.split("=", 1)[1]: f"{version}/{name}" for name in _listed(spark, f"{path}/{version}") if name.startswith(f"{_PART}=")}


def commit(spark: SparkSession, path: str, before: dict, tables: dict[str, tuple[StructType, dict[str, str], set[str]]], writer: str | None = None, batch: int | None = None) -> dict:
    """The next manifest: of each table named its schema, its new parts, and all parts that these take the place of; the rest is as ``before``."""
    after = {"seq": before["seq"] + 1, "tables": dict(before["tables"]), "batches": dict(before["batches"])}
    for table, (schema, new, touched) in tables.items():
        old = before["tables"].get(table, {"parts": {}})["parts"]
        after["tables"][table] = {"schema": schema.jsonValue(), "parts": {p: d for p, d in old.items() if p not in touched} | new}
    if writer is not None:
        after["batches"][writer] = batch
    target, fs = _at(spark, f"{path}/manifests/{after['seq']:012d}.json")
    draft, _ = _at(spark, f"{path}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(after).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"commit {after['seq']} of {path} is there already: two writers?")
    _forget(spark, path)
    return after


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes the manifests before the last KEPT, and the folders that only they name."""
    known = sorted(_numbers(spark, path))
    folders = lambda seq: {d for t in _manifest(spark, path, seq)["tables"].values() for d in t["parts"].values()}
    if old := known[:-KEPT]:
        kept = set().union(*(folders(seq) for seq in known[-KEPT:]))
        for seq in old:
            for d in folders(seq) - kept:
                at, fs = _at(spark, f"{path}/{d}")
                fs.delete(at, True)
            at, fs = _at(spark, f"{path}/manifests/{seq:012d}.json")
            fs.delete(at, False)


def _done(manifest: dict, writer: str | None, batch: int | None) -> bool:
    return writer is not None and batch is not None and manifest["batches"].get(writer, -1) >= batch


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def merge_by_key(
    spark: SparkSession, path: str, new: dict[str, tuple[DataFrame, list[str], Callable[[DataFrame | None, DataFrame], DataFrame]]], *, scope: DataFrame | None = None, buckets: int = 64, writer: str | None = None, batch: int | None = None
) -> dict:
    """Merges new rows into the buckets of their keys, all tables in one commit; a batch that its writer has committed before changes nothing.

    ``new``: of each table its rows, its keys and what makes the new content of
    a bucket of its old (None at first) and new rows.  ``scope`` names the keys
    that are touched, where that is more than the new rows have.  The number of
    buckets has to stay as it was in a table's first commit.
    """
    before = latest(spark, path)
    if _done(before, writer, batch):
        return before
    tables = {}
    for table, (rows, keys, merge) in new.items():
        rows = rows.withColumn(_PART, bucket(keys, buckets)).persist()
        try:
            touched = {r[0] for r in (rows if scope is None else scope.select(bucket(keys, buckets).alias(_PART))).select(_PART).distinct().collect()}
            old = read_table(spark, path, table, sorted(touched), before)
            merged = merge(old, rows.drop(_PART))
            tables[table] = (merged.schema, write_parts(merged.withColumn(_PART, bucket(keys, buckets)), path), touched)
        finally:
            rows.unpersist()
    return commit(spark, path, before, tables, writer, batch)


def replace_scopes(spark: SparkSession, path: str, new: DataFrame, keys: list[str], *, scopes: DataFrame | None = None, table: str = "rows", writer: str | None = None, batch: int | None = None) -> dict:
    """S11 as a sink: the scopes (values of ``keys``) of ``new``, and those of ``scopes``, have the rows of ``new`` from now on; all others stay."""
    before = latest(spark, path)
    if _done(before, writer, batch):
        return before
    part = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    written = write_parts(new.withColumn(_PART, part), path)
    cleared = {r[0] for r in scopes.select(part.alias("p")).distinct().collect()} if scopes is not None else set()
    return commit(spark, path, before, {table: (new.schema, written, set(written) | cleared)}, writer, batch)
