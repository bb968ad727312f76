"""Incremental jobs on Structured Streaming: each run takes what is new and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.notices import upsert
from ledgerlake.sources import files, store


def never_imported(sources: DataFrame) -> DataFrame:
    """Sources without a count."""
    return sources.where("active = 1 AND last_count IS NULL")


def record_counts(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalogue with the counts of the sources just read; others keep theirs."""
    n = rows.groupBy("source_id").agg(F.count("*").alias("_n"))
    return sources.join(n, F.col("id") == F.col("source_id"), "left").withColumn("last_count", F.coalesce("_n", "last_count")).drop("_n", "source_id")


def sync_notices(spark: SparkSession, incoming: str, schema: str, path: str, checkpoint: str, *, enrich: Callable[[DataFrame], DataFrame] | None = None, format: str = "json", buckets: int = 64) -> StreamingQuery:  # noqa: A002
    """I2 + I3: new files of ``incoming`` upserted into the store at ``path``, and enriched (classified) on the way.

    A batch reads and writes only the buckets of its notices.  The upsert is by
    key and sequence, and a batch is committed with its number, so one that is
    run again after a lost driver changes nothing, and late or repeated releases
    find their place.
    """

    def batch(new: DataFrame, number: int) -> None:
        rows = enrich(new) if enrich else new
        store.merge_by_key(spark, path, {"rows": (rows, ["ocid"], lambda old, fresh: upsert(old, fresh, track=True))}, buckets=buckets, writer=checkpoint, batch=number)

    return spark.readStream.schema(schema).format(format).load(incoming).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FILES = "path string, modificationTime timestamp, length long, content binary"


def import_payment_files(spark: SparkSession, folder: str, path: str, checkpoint: str, tokens: list[str], spec: DataFrame, *, buckets: int = 64, files_a_batch: int = 1000) -> StreamingQuery:
    """I1 + S1-S6: the new files of a growing folder into the store at ``path``: their payments, and a row a file with its header and count.

    Table rows: file, line_no and the mapped fields, as text.  Table files: file,
    header_no (NULL: no header was found), records.  Both change in one commit,
    with the batch's number, so no file is counted without its rows or twice.  A
    file that comes again takes the place of what it had.  Only the names of a
    batch's files, and a row for each of their blocks, go through the driver; the
    files are read block by block.
    """

    def replaced(old: DataFrame | None, new: DataFrame, came: DataFrame) -> DataFrame:
        return new if old is None else old.join(F.broadcast(came), "file", "left_anti").unionByName(new)

    def batch(new: DataFrame, number: int) -> None:
        paths = [r["path"] for r in new.collect()]
        came = spark.createDataFrame([(p,) for p in paths], "file string")
        lines = files.read_lines(spark, paths)
        # A row a file, which is read in several places.
        known = files.separators(lines).persist()
        rows, headers = files.after_header(files.cells(lines, known), tokens, kept=True)
        rows = files.pick_columns(rows, files.map_columns(headers, spec))
        counts = rows.groupBy("file").agg(F.count("*").alias("records"))
        found = came.join(headers.select("file", "header_no"), "file", "left").join(counts, "file", "left").withColumn("records", F.coalesce("records", F.lit(0)))
        merge = lambda old, fresh: replaced(old, fresh, came)
        try:
            store.merge_by_key(spark, path, {"rows": (rows, ["file"], merge), "files": (found, ["file"], merge)}, scope=came, buckets=buckets, writer=checkpoint, batch=number)
        finally:
            known.unpersist(), headers.unpersist()

    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).load(folder).select("path")
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
