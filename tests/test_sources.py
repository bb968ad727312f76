"""Files in, files out, incremental runs."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ledgerlake.operators.filters import period_of_shared_files
from ledgerlake.sources import files, html, ocds, sinks, store
from ledgerlake.streaming import incremental


def test_decode():
    text = "Réf,£1"
    for code in ("utf-8", "utf-8-sig", "utf-16", "cp1252"):
        assert files.decode_bytes(text.encode(code)) == text
    assert files.decode_bytes("abcdefgh,1,2".encode("utf-16-le")) == "abcdefgh,1,2" and files.decode_bytes(b"PK\x03\x04x") is None and files.decode_bytes(None) is None and files.decode_bytes(b"") == ""


def test_catalogue_to_rows(spark, tmp_path):
    a, b, c = tmp_path / "a.csv", tmp_path / "b.txt", tmp_path / "c.zip"
    a.write_bytes("﻿Title\r\nSupplier,Amount,Date\r\n\"Acme, Ltd\",\"1,000\",01/02/2023\r\n\r\n,,\r\nB,2,02/02/2023".encode())
    b.write_bytes("Date\tName\tPaid\n03/02/2023\tCafé\t5".encode("cp1252"))
    c.write_bytes(b"PK\x03\x04")
    cat = spark.createDataFrame([(1, str(a), "2023-02", 1, 0, 1, 2, -1, -1), (2, str(b), "2023-02", 1, 1, 2, 0, -1, -1), (3, str(c), "2023-02", 0, 0, 1, 2, -1, -1)], "source_id int, url string, period string, skip_rows int, col_supplier int, col_amount int, col_date int, col_service int, col_category int")
    got = [(r.source_id, r.supplier, r.amount, r.date, r.service) for r in files.read_spend_files(spark, cat).orderBy("source_id", "line_no").collect()]
    assert got == [(1, "Acme, Ltd", "1,000", "01/02/2023", None), (1, "B", "2", "02/02/2023", None), (2, "Café", "5", "03/02/2023", None)]


def test_headers(spark):
    df = spark.createDataFrame([("f", 0, ["Report", "x", "y"]), ("f", 3, ["Supplier Name", "Net Amount", "Date", "Amount"]), ("f", 5, ["A", "1", "2", "3"]), ("g", 0, ["no", "header", "here"])], "file string, line_no int, cells array<string>")
    data, headers = files.after_header(df, ["supplier", "amount"])
    spec = spark.createDataFrame([("supplier", "supplier", "prefix"), ("amount", "amount", "substr"), ("date", "date", "exact")], "field string, text string, mode string")
    at = files.map_columns(headers, spec)
    assert {(r.file, r.field): r.pos for r in at.collect()} == {("f", "supplier"): 0, ("f", "amount"): 3, ("f", "date"): 2}
    assert [(r.supplier, r.amount, r.date, r.service) for r in files.pick_columns(data, at).collect()] == [("A", "3", "2", None)]


def test_reference_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text(" LAD_Code , Population\nE1, 100\nE2\nE3,x\n")
    got = [tuple(r) for r in files.read_reference_csv(spark, str(tmp_path / "r.csv"), "lad_code string, population int, other string").collect()]
    assert got == [("E1", 100, None), ("E2", None, None), ("E3", None, None)]


def test_html(spark):
    page = "<p>a</p><table><tr><th>Name</th><th>&pound;</th></tr><tr><td><b>A &amp; B</b></td><td> 5&nbsp;0 </td></tr></table><table><tr><td>z</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, "none"), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.cells) for r in html.table_rows(df).orderBy("row_no").collect()] == [(1, ["Name", "£"]), (1, ["A & B", "5 0"])]
    assert df.select(html.html_text(F.lit("<script>x</script><p>a&lt;b</p> c")).alias("t")).first().t == "a<b c"


RELEASES = [
    {"ocid": "o1", "date": "2024-03-01T10:00:00Z", "tag": ["tender"], "buyer": {"name": "B"}, "tender": {"title": "<b>T</b>", "status": "active", "value": {"amount": 5, "currency": "GBP"}, "classification": {"id": "72000000"}, "tenderPeriod": {"endDate": "2024-04-01T00:00:00Z"}, "items": [{"deliveryAddresses": [{"region": "UKC"}]}], "documents": [{"documentType": "tenderNotice", "url": "u"}]}},
    {"ocid": "o2", "date": "2024-03-02", "tag": ["award"], "buyer": {"name": "B"}, "tender": {"title": "T2"}, "awards": [{"status": "active", "value": {"amount": 7}, "suppliers": [{"name": "S1"}, {"name": "S2"}]}, {"suppliers": [{"name": "S1"}]}]},
    {"ocid": None, "buyer": {"name": "x"}}, {"ocid": "o3", "buyer": None},
]


def test_ocds(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, RELEASES)))
    got = {r.ocid: r for r in ocds.read_ocds(spark, str(tmp_path / "r.json")).collect()}
    assert set(got) == {"o1", "o2"} and got["o1"].stage == "tender" and got["o1"].title == "T" and got["o1"].cpv_division == "72" and got["o1"].region == "UKC" and got["o1"].tender_end_date == dt.date(2024, 4, 1) and got["o1"].official_url == "u"
    assert got["o1"].status == "active" and got["o2"].status == "complete" and got["o2"].stage == "award" and got["o2"].supplier_names == "S1 | S2" and float(got["o2"].value_amount) == 7
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write(json.dumps({"ocid": "c1", "date": "2024-01-01", "buyer": {"name": "B"}, "tender": {"title": "x", "status": "withdrawn"}, "contracts": [{"value": {"amount": 3}}, {"value": {"amount": 4}}], "parties": [{"name": "P", "roles": ["supplier"]}, {"name": "Q", "roles": ["buyer"]}]}))
    r = ocds.read_ocds(spark, str(tmp_path / "c.jsonl.gz"), "compiled", "Wales").first()
    assert (r.stage, r.status, float(r.value_amount), r.supplier_names, r.region) == ("award", "withdrawn", 7.0, "P", "Wales")


def test_publish_and_queue(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.publish(spark.range(3).toDF("x"), at)
    sinks.publish(sinks.published(spark, at).where("x > 0"), at)
    assert sinks.published(spark, at).count() == 2
    assert sinks.published(spark, at + "/none") is None
    # A job lost before, or while, the pointer is written leaves the last version in place; later ones follow on.
    real = DataFrameWriter.json
    try:
        DataFrameWriter.json = lambda *_, **__: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(RuntimeError):
            sinks.publish(spark.range(9).toDF("x"), at)
    finally:
        DataFrameWriter.json = real
    assert sinks.published(spark, at).count() == 2
    for n in range(4, 9):
        sinks.publish(spark.range(n).toDF("x"), at)
        assert sinks.published(spark, at).count() == n
    sinks.write_tsv(spark.range(2).toDF("x"), str(tmp_path / "q"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "q")).count() == 2
    got = sinks.shard(spark.range(100).withColumn("dead", F.col("id") % 10 == 0), ["id"], per=18, dead="dead").orderBy("id").collect()
    assert [r.shard for r in got] == [k // 18 + 1 for k in range(90)]


def test_shared_files(spark):
    rows = spark.createDataFrame([(1, dt.date(2023, 1, 5)), (1, dt.date(2023, 2, 5)), (2, dt.date(2023, 2, 6)), (1, None), (3, dt.date(2020, 1, 1))], "source_id int, paid_date date")
    cat = spark.createDataFrame([(1, "u", "2023-01"), (2, "u", "2023-02"), (3, "v", "2023-01")], "source_id int, url string, period string")
    assert sorted((r.source_id, str(r.paid_date)) for r in period_of_shared_files(rows, cat).collect()) == [(1, "2023-01-05"), (2, "2023-02-06"), (3, "2020-01-01")]


def test_incremental_sync(spark, tmp_path):
    schema, seen = "ocid string, seq int, status string, value_amount double", []
    at = [str(tmp_path / n) for n in ("in", "store", "check")]

    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))

    def mark(df):
        seen.append(df.count())
        return df.withColumn("title", F.upper("status"))

    for name, rows in (("a.json", [{"ocid": "x", "seq": 1, "status": "active", "value_amount": 5}, {"ocid": "y", "seq": 1, "status": "active"}]), ("b.json", [{"ocid": "x", "seq": 3, "status": "complete"}, {"ocid": "y", "seq": 0, "status": "old", "value_amount": 2}])):
        put(name, rows)
        incremental.sync_notices(spark, at[0], schema, at[1], at[2], enrich=mark).awaitTermination()
    got = {r.ocid: (r.status, r.value_amount, r.title) for r in store.read_table(spark, at[1]).collect()}
    assert seen == [2, 2] and got == {"x": ("complete", 5.0, "COMPLETE"), "y": ("active", 2.0, "ACTIVE")}


def test_sources_to_read(spark):
    s = spark.createDataFrame([(1, 1, None), (2, 1, 5), (3, 0, None)], "id int, active int, last_count long")
    assert [r.id for r in incremental.never_imported(s).collect()] == [1]
    rows = spark.createDataFrame([(1,), (1,)], "source_id int")
    assert {r.id: r.last_count for r in incremental.record_counts(s, rows).collect()} == {1: 2, 2: 5, 3: None}


def test_lines_of_files_read_in_blocks(spark, tmp_path, monkeypatch):
    """The same lines and numbers as of files read whole, which only UTF-16 and packed ones are now."""
    many = "".join(f"{k},Ash £ {k},x{chr(13) if k % 3 else ''}\n" for k in range(400))
    odd = {
        "plain.csv": many.encode(), "cut [1]*?{a}%20 b.csv": many.encode("cp1252"), "late.csv": many.replace("£", "-").encode() + b"\xa3,1,2\n", "mark.csv": b"\xef\xbb\xbfa,b,c\r\n1,2,3", "old.csv": b"a,b,c\r1,2,3\r\r4,5,6\r",
        "nul.csv": b"a,b\x00,c\r\x00\n\n  \n1,2,3\n\r4,5,6\n", "split.csv": b"a\xc3\n\xa9b\n", "empty.csv": b"", "blank.csv": b"\n\n", "u.csv": many[:2000].encode("utf-16"), "v.csv": many[:2000].encode("utf-16-be"), "z.zip": b"PK\x03\x04\n1,2,3\n" + bytes(99), "g.csv.gz": gzip.compress(b"a,b,c\n"),
    }
    for name, raw in odd.items():
        (tmp_path / name).write_bytes(raw)
    given = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    want = sorted(map(tuple, files.lines(files.decode_files(given)).collect()))
    paths, whole, decode = [r.path for r in given.select("path").collect()], [], files.decode_files
    assert len(paths) == len(odd) - 1  # Spark passes over the empty one
    monkeypatch.setattr(files, "decode_files", lambda df: whole.extend(r.path.rsplit("/", 1)[1] for r in df.collect()) or decode(df))
    for size in ("128m", "999", "640"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert sorted(map(tuple, files.read_lines(spark, paths).collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(whole) == ["g.csv.gz", "u.csv", "v.csv"]
        whole.clear()


def test_payment_stream_holds_no_file_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Supplier,Amount,Date\nAsh,1,01/02/2024\n")
    monkeypatch.setattr(files, "decode_files", lambda df: pytest.fail("read whole"))
    spec = spark.createDataFrame([("supplier", "supplier", "exact"), ("amount", "amount", "exact")], "field string, text string, mode string")
    incremental.import_payment_files(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "c"), ["supplier", "amount"], spec, buckets=2).awaitTermination()
    assert [(r.line_no, r.supplier) for r in store.read_table(spark, str(tmp_path / "store")).collect()] == [(1, "Ash")]
