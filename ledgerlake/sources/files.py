"""Payment and reference files: catalogue-driven reading, decoding, headers and columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.operators.match import small
from ledgerlake.operators.ordered import numbered

#: First bytes of archives and of old office files, which are skipped.
BINARY_HEADS = (b"PK\x03\x04", b"\xd0\xcf\x11\xe0")
#: Names of files that Spark's text reader unpacks by itself.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd", ".lzo", ".xz", ".z")
HEAD = 200  # bytes that tell the kind of a file
FIELDS = ("supplier", "amount", "date", "service", "category")


def decode_bytes(raw: bytes | None) -> str | None:
    """UTF-16 by mark or by over five NULs in the first 200 bytes, UTF-8 with or without mark, else Windows-1252; None for archives."""
    if raw is None or raw.startswith(BINARY_HEADS):
        return None
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return raw.decode("utf-16", "replace")
    head = raw[:200]
    if head.count(0) > 5:
        return raw.decode("utf-16-be" if head[0::2].count(0) > head[1::2].count(0) else "utf-16-le", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def decode_files(files: DataFrame, *, content: str = "content") -> DataFrame:
    """``files`` (as the binaryFile source gives them) with ``text`` in place of the bytes.  Undecodable kinds drop.

    Spark's own decoders lack Windows-1252 and the guess, so this one is an Arrow helper.
    """
    kept = [f for f in files.schema.fields if f.name not in (content, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([decode_bytes(x) for x in b.column(b.schema.get_field_index(content)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), text], names=[*(f.name for f in kept), "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])
    return files.mapInArrow(run, schema).where("text IS NOT NULL")


def lines(files: DataFrame, *, file: str = "path") -> DataFrame:
    """S3: (file, line_no, line): NULs dropped, line ends made alike, blank lines dropped."""
    clean = F.regexp_replace(F.translate("text", "\x00", ""), "\r\n?", "\n")
    rows = files.select(F.col(file).alias("file"), F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array]]:
    """(file, block, size) and the pieces of each run of rows of one block."""
    keys = batch.columns[:3]
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in keys:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield tuple(c[lo].as_py() for c in keys), batch.column(3)[lo:hi]


def _plain(raw: pa.Array) -> bool:
    """Whether each piece is one line as it stands."""
    return not any(pc.any(pc.match_substring(raw, c)).as_py() for c in (b"\r", b"\x00"))


def _cut(piece: bytes) -> list[bytes]:
    """The lines of what stands between two line feeds."""
    return piece.replace(b"\x00", b"").removesuffix(b"\r").split(b"\r")


def _utf8(raw: pa.Array) -> bool:
    try:
        raw.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, size, lines, utf8, head): a row for each block."""
    key, n, fine, head = None, 0, True, b""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, n, fine, head[:HEAD]), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["file", "block", "size", "lines", "utf8", "head"])

    for batch in batches:
        for k, raw in _runs(batch):
            if k != key:
                if key is not None:
                    yield row()
                key, n, fine, head = k, 0, True, b""
            n += len(raw) if _plain(raw) else sum(len(_cut(x)) for x in raw.to_pylist())
            fine = fine and _utf8(raw)
            at = 0
            while len(head) < HEAD and at < len(raw):
                head, at = head + raw[at].as_py()[:HEAD] + b"\n", at + 1
    if key is not None:
        yield row()


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S2 + S3: what ``lines`` of ``decode_files`` gives for these files, read block by block, so that none is held whole.

    Files are cut at line feeds by Spark's text reader.  A first pass has each
    block's lines, whether they are UTF-8, and the first bytes; from these, a row a
    block, the driver tells each file's encoding and its blocks' first line numbers.
    UTF-16 and files that the text reader would unpack are read whole.
    """
    # Names are no patterns.
    at = lambda given: [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in given]
    pieces = spark.read.schema("value string").option("lineSep", "\n").text(at(paths)).select(*(F.col(f"_metadata.file_{c}").alias(a) for c, a in (("path", "file"), ("block_start", "block"), ("block_length", "size"))), F.col("value").cast("binary").alias("raw"))
    blocks = sorted(map(tuple, pieces.mapInArrow(_surveyed, "file string, block long, size long, lines long, utf8 boolean, head binary").collect()))
    known, names, codes = set(paths), {}, {}
    first: dict[tuple, int] = {}
    last, n = None, 0
    for file, block, size, count, fine, head in blocks:
        if file != last:
            last, n = file, 0
            # The text reader's names are escaped.
            names[file] = unquote(file)
            if names[file] not in known:
                raise ValueError(f"{file} is none of the files to read")
            whole = head.startswith((b"\xff\xfe", b"\xfe\xff")) or bytes(head).count(0) > 5
            codes[file] = "whole" if file.lower().endswith(PACKED) else None if head.startswith(BINARY_HEADS) else "whole" if whole else "utf-8"
        if codes[file] == "utf-8" and not fine:
            codes[file] = "cp1252"
        first[file, block, size], n = n, n + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for batch in batches:
            for k, raw in _runs(batch):
                if k != key:
                    key, n = k, first[k]
                code = codes[k[0]]
                if code in (None, "whole"):
                    continue
                if not _plain(raw):
                    raw = pa.array([x for piece in raw.to_pylist() for x in _cut(piece)], pa.binary())
                text = raw.cast(pa.string()) if code == "utf-8" else pa.array([x.decode(code, "replace") for x in raw.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(names[k[0]], pa.string()), len(text)), pa.array(np.arange(n, n + len(text)), pa.int32()), text], names=["file", "line_no", "line"])
                n += len(text)

    out = pieces.mapInArrow(run, "file string, line_no int, line string").where(F.trim("line") != "")
    if whole := [names[f] for f, code in codes.items() if code == "whole"]:
        out = out.unionByName(lines(decode_files(spark.read.format("binaryFile").load(at(whole)).select("path", "content"))))
    return out


def separator(line: Column) -> Column:
    """Tab where a line has more tabs than commas."""
    n = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return F.when(n("\t") > n(","), "\t").otherwise(",")


def separators(rows: DataFrame) -> DataFrame:
    """(file, _sep), from each file's first line."""
    return rows.groupBy("file").agg(F.min_by("line", "line_no").alias("_first")).select("file", separator(F.col("_first")).alias("_sep"))


def cells(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``cells`` of each line; a file's separator comes from its first line.  Rows of under three cells, or blank ones, drop.

    Quoted cells may hold separators and doubled quotes, but no line end.
    """
    r = rows.join(F.broadcast(separators(rows) if known is None else known), "file")

    def cut(sep: str) -> Column:
        found = F.regexp_extract_all(F.concat(F.lit(sep), F.col("line")), F.lit(rf'{sep}("(?:[^"]|"")*"|[^{sep}]*)'), 1)
        return F.transform(found, lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)))

    r = r.withColumn("cells", F.when(F.col("_sep") == "\t", cut("\t")).otherwise(cut(","))).drop("_sep", "line")
    return r.where((F.size("cells") >= 3) & F.exists("cells", lambda c: c != ""))


def normal_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def _has(token: str) -> Callable[[Column], Column]:
    return lambda c: c.contains(token)


def after_header(rows: DataFrame, tokens: list[str], max_scan: int = 25, *, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """(data, headers): the first of a file's first rows that has all ``tokens`` among its cells is the header; data stands below it.

    Files without one have no data.  ``kept``: the headers are persisted.
    """
    names = F.transform("cells", normal_header)
    test = F.lit(True)
    for token in tokens:
        test = test & F.exists(names, _has(token))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
    headers = numbered.where((F.col("_n") <= max_scan) & test).groupBy("file").agg(F.min_by(F.struct("line_no", "cells"), "line_no").alias("h")).select("file", F.col("h.line_no").alias("header_no"), F.col("h.cells").alias("header"))
    headers = headers.persist() if kept else headers
    data = rows.join(F.broadcast(headers.select("file", "header_no")), "file").where(F.col("line_no") > F.col("header_no")).drop("header_no")
    return data, headers


def map_columns(headers: DataFrame, spec: DataFrame) -> DataFrame:
    """(file, field, pos) from header texts and ``spec`` (field, text, mode exact | substr | prefix); empty cells don't match, the last match wins."""
    h = headers.select("file", F.posexplode("header").alias("pos", "cell")).withColumn("cell", normal_header(F.col("cell"))).where("cell <> ''")
    s = spec.select("field", F.lower("text").alias("_t"), "mode")
    test = F.when(F.col("mode") == "exact", F.col("cell") == F.col("_t")).when(F.col("mode") == "substr", F.col("cell").contains(F.col("_t"))).otherwise(F.col("cell").startswith(F.col("_t")))
    return h.join(small(s), test).groupBy("file", "field").agg(F.max("pos").alias("pos"))


def pick_columns(data: DataFrame, positions: DataFrame) -> DataFrame:
    """The mapped fields of each row as columns; fields that a file lacks are NULL."""
    wide = positions.groupBy("file").pivot("field", list(FIELDS)).agg(F.max("pos"))
    wide = wide.select(F.col("file").alias("_file"), *(F.col(f).alias(f"_{f}") for f in FIELDS))
    r = data.join(F.broadcast(wide), F.col("file") == F.col("_file"))
    return r.select("file", "line_no", *(F.get("cells", F.col(f"_{f}")).alias(f) for f in FIELDS))


def read_spend_files(spark: SparkSession, catalogue: DataFrame) -> DataFrame:
    """Rows of the catalogue's files by position (0-based, -1: absent), with source_id and period; each file is read once.

    ``catalogue``: source_id, url, period, skip_rows, col_supplier, col_amount,
    col_date, col_service, col_category.  The list of paths goes through the
    driver, the files don't.
    """
    paths = [r["url"] for r in catalogue.select("url").distinct().collect()]
    text = decode_files(spark.read.format("binaryFile").load(paths).select("path", "content"))
    rows = numbered(cells(lines(text)), "file", "line_no", "_row")
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    r = rows.withColumn("_url", plain(F.col("file"))).join(catalogue.withColumn("_url", plain(F.col("url"))), "_url").where(F.col("_row") >= F.col("skip_rows"))
    at = lambda f: F.when(F.col(f"col_{f}") >= 0, F.get("cells", F.col(f"col_{f}"))).alias(f)
    return r.select("source_id", "period", "url", "line_no", *(at(f) for f in FIELDS))


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headed CSV; headers are trimmed and lower-cased, columns go by name, short rows are padded."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    want = spark.createDataFrame([], schema).schema.fields
    return raw.select(*((F.trim(F.col(f.name)).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want))
