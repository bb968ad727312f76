"""The part store: what is untouched stays, what is lost half-way changes nothing, what comes twice counts once."""

import json
from pathlib import Path

import pytest

from ledgerlake.operators.notices import SEQUENCES, upsert
from ledgerlake.sources import store
from ledgerlake.streaming import incremental

NOTICE = "ocid string, seq long, status string, value_amount double, title string"


def files_of(spark, path, table="rows"):
    """The names of the data files of each part."""
    return {p: sorted(f.name for f in Path(path, d).glob("part-*")) for p, d in store.latest(spark, path)["tables"][table]["parts"].items()}


def content(spark, path, table="rows"):
    return sorted(map(str, map(tuple, store.read_table(spark, path, table).drop(SEQUENCES).collect())))


@pytest.fixture
def feed(tmp_path):
    (tmp_path / "in").mkdir()
    n = iter(range(99))

    def put(rows):
        (tmp_path / "in" / f"{next(n)}.json").write_text("\n".join(json.dumps(r) for r in rows))

    return put, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "checkpoint")


def sync(spark, at):
    incremental.sync_notices(spark, at[0], NOTICE, at[1], at[2], buckets=16).awaitTermination()


def test_only_touched_buckets_are_written(spark, feed):
    put, *at = feed
    put([{"ocid": f"n{k}", "seq": 1, "status": "active", "value_amount": k, "title": "t"} for k in range(60)])
    sync(spark, at)
    before = files_of(spark, at[1])
    put([{"ocid": "n7", "seq": 2, "status": "complete"}, {"ocid": "n7", "seq": 0, "status": "planned", "value_amount": 99}])
    sync(spark, at)
    after = files_of(spark, at[1])
    changed = {p for p in before if before[p] != after[p]}
    assert len(before) > 8 and len(changed) == 1 and before.keys() == after.keys()
    rows = {r.ocid: (r.status, r.value_amount) for r in store.read_table(spark, at[1]).collect()}
    assert len(rows) == 60 and rows["n7"] == ("complete", 7.0) and rows["n8"] == ("active", 8.0)


def test_batch_that_runs_again_changes_nothing(spark, feed):
    put, *at = feed
    put([{"ocid": "a", "seq": 1, "status": "active"}])
    sync(spark, at)
    first = store.latest(spark, at[1])
    again = spark.createDataFrame([("a", 9, "late", None, None)], NOTICE)
    assert store.merge_by_key(spark, at[1], {"rows": (again, ["ocid"], upsert)}, buckets=16, writer=at[2], batch=0) == first
    assert content(spark, at[1]) == ["('a', 1, 'active', None, None)"]


def test_versions_in_any_order(spark):
    """Every order of the same versions, each its own batch, gives what one aggregate over all of them gives."""
    import itertools

    kind = "ocid string, seq long, status string, value_amount double, published_date string, region string"
    versions = [("a", 1, "s1", 5.0, None, "r1"), ("a", 2, "s2", None, "p2", None), ("a", 3, "s3", 7.0, "p3", None), ("a", 4, "s4", None, None, None)]
    df = lambda rows: spark.createDataFrame(rows, kind)
    for order in itertools.permutations(versions):
        held = None
        for v in order:
            held = spark.createDataFrame(upsert(held, df([v]), track=True).collect(), held.schema if held is not None else upsert(None, df([v]), track=True).schema)
        assert tuple(held.drop(SEQUENCES).first()) == ("a", 4, "s4", 7.0, "p2", "r1"), order


def test_lost_between_write_and_commit(spark, feed, monkeypatch):
    put, *at = feed
    put([{"ocid": "a", "seq": 1, "status": "active"}, {"ocid": "b", "seq": 1, "status": "active"}])
    sync(spark, at)
    before, held = store.latest(spark, at[1]), content(spark, at[1])
    put([{"ocid": "a", "seq": 2, "status": "complete"}])
    real = store.commit

    def lost(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(store, "commit", lost)
    with pytest.raises(Exception, match="lost"):
        sync(spark, at)
    assert store.latest(spark, at[1]) == before and content(spark, at[1]) == held
    monkeypatch.setattr(store, "commit", real)
    sync(spark, at)
    assert {r.ocid: r.status for r in store.read_table(spark, at[1]).collect()} == {"a": "complete", "b": "active"}


def test_scopes_are_replaced(spark, tmp_path, monkeypatch):
    path, kind = str(tmp_path / "s"), "council string, source_id int, amount int"
    df = lambda rows: spark.createDataFrame(rows, kind)
    assert store.read_table(spark, path) is None
    store.replace_scopes(spark, path, df([("A", 1, 10), ("A", 2, 20), ("B/x", 1, 30), (None, 1, 40), ("", 1, 50)]), ["council", "source_id"])
    before = files_of(spark, path)
    store.replace_scopes(spark, path, df([("A", 2, 21), ("A", 2, 22), (None, 1, 41), ("C", 5, 60)]), ["council", "source_id"], scopes=df([("", 1, 0), ("never", 1, 0)]))
    assert content(spark, path) == sorted(map(str, [("A", 1, 10), ("A", 2, 21), ("A", 2, 22), ("B/x", 1, 30), (None, 1, 41), ("C", 5, 60)]))
    after = files_of(spark, path)
    assert len([p for p in before if before[p] == after.get(p)]) == 2
    # A job that is lost after its files are written: readers see what was there.
    held = content(spark, path)
    monkeypatch.setattr(store, "commit", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.replace_scopes(spark, path, df([("A", 1, 11)]), ["council", "source_id"])
    assert content(spark, path) == held


def test_old_commits_go(spark, tmp_path):
    path = str(tmp_path / "s")
    for k in range(6):
        store.replace_scopes(spark, path, spark.createDataFrame([("A", k), ("B" if k == 0 else "A", k)], "council string, n int"), ["council"])
    assert len(list(Path(path, "manifests").glob("*.json"))) == store.KEPT
    assert len(list(Path(path, "data").glob("*/_part=*/part-*.parquet"))) == store.KEPT + 1
    assert content(spark, path) == sorted(map(str, [("A", 5), ("A", 5), ("B", 0)]))
    with pytest.raises(RuntimeError):
        store.commit(spark, path, {"seq": 5, "tables": {}, "batches": {}}, {})


def test_payment_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = [str(tmp_path / x) for x in ("in", "store", "checkpoint")]
    spec = spark.createDataFrame([("supplier", "supplier", "prefix"), ("amount", "amount", "substr"), ("date", "date", "substr")], "field string, text string, mode string")
    run = lambda checkpoint=at[2]: incremental.import_payment_files(spark, at[0], at[1], checkpoint, ["supplier", "amount"], spec, buckets=8).awaitTermination()
    counts = lambda: {r.file.rsplit("/", 1)[1]: (r.header_no, r.records) for r in store.read_table(spark, at[1], "files").collect()}
    (tmp_path / "in" / "a.csv").write_text("Payments over 500,,\nSupplier,Amount,Date\nAsh,1,01/02/2024\nBay,2,02/02/2024\n")
    (tmp_path / "in" / "b.csv").write_bytes("Supplier\tDate\tAmount\nCob £\t01/03/2024\t5\n".encode("utf-16"))
    run()
    assert counts() == {"a.csv": (1, 2), "b.csv": (0, 1)}
    seq = store.latest(spark, at[1])["seq"]
    run()
    assert store.latest(spark, at[1])["seq"] == seq
    (tmp_path / "in" / "c.csv").write_text("no header,at,all\n1,2,3\n")
    (tmp_path / "in" / "d.zip").write_bytes(b"PK\x03\x04....")
    run()
    assert counts() == {"a.csv": (1, 2), "b.csv": (0, 1), "c.csv": (None, 0), "d.zip": (None, 0)}
    rows = store.read_table(spark, at[1])
    assert sorted((r.supplier, r.amount, r.date) for r in rows.collect()) == [("Ash", "1", "01/02/2024"), ("Bay", "2", "02/02/2024"), ("Cob £", "5", "01/03/2024")]
    # Another reader's first run takes all files again: each replaces what it had.
    (tmp_path / "in" / "a.csv").write_text("now,without,header\n")
    run(at[2] + "2")
    assert counts()["a.csv"] == (None, 0) and [r.supplier for r in store.read_table(spark, at[1]).collect()] == ["Cob £"]
