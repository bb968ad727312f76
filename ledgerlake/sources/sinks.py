"""Writing: scoped replacement, published versions, queues."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_scope(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with all rows of the scopes that ``new`` has replaced by ``new``."""
    scopes = new.select(*keys).distinct()
    return target.join(scopes, keys, "left_anti").unionByName(new)


POINTER = "seq long, version string"


def publish(df: DataFrame, path: str, keep: int = 3) -> str:
    """Write a new version beside the old ones and name it in ``path``/CURRENT; readers see the old or the new one, whole.

    CURRENT is only ever added to, one small file a version, and the file with the
    highest number holds: a job lost at any point leaves the last version in
    place.  One writer at a time.  Versions older than the last ``keep`` are
    removed afterwards.  All goes through the session's file system, so any store works.
    """
    spark = df.sparkSession
    known = _pointers(spark, path)
    seq, version = max((r["seq"] for r in known), default=0) + 1, f"{path}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(version)
    spark.createDataFrame([(seq, version)], POINTER).coalesce(1).write.mode("append").json(f"{path}/CURRENT")
    for old in sorted(known, key=lambda r: r["seq"])[: max(0, len(known) + 1 - keep)]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old["version"])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return version


def _pointers(spark: SparkSession, path: str) -> list:
    """A row a version, none where nothing has been published yet."""
    try:
        return spark.read.schema(POINTER).json(f"{path}/CURRENT").where("version IS NOT NULL").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The last published version; None where there is none yet."""
    known = _pointers(spark, path)
    return spark.read.parquet(max(known, key=lambda r: r["seq"])["version"]) if known else None


def write_tsv(df: DataFrame, path: str) -> None:
    """S13."""
    df.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def shard(queue: DataFrame, order: list[str], per: int = 18, dead: str | None = None) -> DataFrame:
    """A work queue in numbered shards of ``per`` rows, without rows flagged ``dead``.

    Row numbers come from sorted partitions and their sizes, not from one task:
    the queue is range-partitioned, each part is numbered by itself, and the
    parts' offsets (one number a part) are added.
    """
    q = queue.where(~F.coalesce(F.col(dead), F.lit(False))) if dead else queue
    parts = q.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    numbered = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_off")
    return numbered.join(F.broadcast(offsets), "_part").withColumn("shard", F.floor((F.col("_off") + F.col("_rn") - 1) / per) + 1).drop("_part", "_rn", "_off")
