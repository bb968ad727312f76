"""Every registered query against its oracle SQL on the smallest tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlake.operators import clusters, contracts, match, notices, ordered
from ledgerlake.operators import summaries as S
from ledgerlake.plans import registries
from ledgerlake.plans.spend import SHARES
from ledgerlake.plans.fixtures import Inputs

NAMES = sorted(n for r in registries() for n in r.queries)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(*cols).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        assert rows == sorted(tuple(map(str, r)) for r in duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_joint_split_keeps_the_total(spark, sf):
    i = Inputs(spark, sf)
    from ledgerlake.operators.filters import live

    whole = i.spend.where(live()).agg(F.sum("amount").cast("double")).first()[0]
    assert S.council_summary(i.spend, SHARES).agg(F.sum("total_spend")).first()[0] == pytest.approx(whole)


def test_nation_rows_are_within_all_nations(spark, sf):
    i = Inputs(spark, sf)
    s = S.supplier_nation_fy(i.spend, i.config, {})
    a, n = s.where("nation = ''"), s.where("nation <> ''").groupBy("supplier_canon", "fy").agg(F.sum("payment_count").alias("m"), F.max("council_count").alias("c"))
    assert a.join(n, ["supplier_canon", "fy"]).where("payment_count < m OR council_count < c").count() == 0


def test_keyword_late_in_a_long_text(spark, tmp_path):
    rows = [(1, "src1", "word " * 3000 + "the th"), (2, "src1", "word " * 3000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["f11_keyword_search"](spark, str(tmp_path)).collect()
    assert [r.ocid for r in got] == ["ocds-1"]


def test_guards(spark):
    rules = spark.createDataFrame([(1, "larch uk", "Larch", "substring", 0), (2, "heron", "Heron", "substring", 0), (3, "hornwell", "Sedge", "substring", 0), (4, "sedgereunis", "SedgeReunis", "substring", 0)], "id int, pattern string, canonical_name string, match_type string, confirmed_invalid int")
    guards = [{"all_of": ["larch uk", "finch"], "result": None}, {"all_of": ["bramble", "thornwell"], "result": None}, {"exact": ["heron network systems ltd"], "result": "Heron"}]
    names = spark.createDataFrame([(n,) for n in ("Larch UK Ltd T/A Finch", "Larch UK Ltd", "Bramble & Thornwells Ltd", "Heron Network Systems Ltd", "SedgeRéunis UK Limited", None)], "supplier_raw string")
    got = {r.supplier_raw: r.supplier_canon for r in match.match_supplier(names, rules, guards=guards).collect()}
    assert got == {"Larch UK Ltd T/A Finch": None, "Larch UK Ltd": "Larch", "Bramble & Thornwells Ltd": None, "Heron Network Systems Ltd": "Heron", "SedgeRéunis UK Limited": "SedgeReunis"}


def test_upsert_is_idempotent_and_needs_no_order(spark):
    rng = random.Random(1)
    rows = [(f"o{rng.randrange(9)}", k, rng.choice(["active", None, "complete"]), rng.choice([None, float(k)]), rng.choice([None, f"d{k}"])) for k in range(80)]
    schema = "ocid string, seq int, status string, value_amount double, published_date string"
    def run(order):
        a, b = order[:40], order[40:]
        once = notices.upsert(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
        return sorted(map(str, once.collect()))
    first = run(rows)
    want = {}
    for o, k, s, v, p in rows:
        w = want.setdefault(o, [k, s, v, p])
        w[0], w[1], w[2], w[3] = k, s, w[2] if v is None else v, w[3] if w[3] is not None else p
    assert {tuple(x) for x in [(o, *w) for o, w in want.items()]} == {tuple(r) for r in notices.upsert(None, spark.createDataFrame(rows, schema)).collect()}
    assert first == sorted(map(str, notices.upsert(None, spark.createDataFrame(rows + rows[:30], schema)).collect()))


def test_overlaps_against_pairs(spark):
    rng = random.Random(2)
    day = lambda: rng.choice([None, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(40))])
    rows = [(k, "c", rng.choice("ab"), day(), day(), 1) for k in range(120)]
    got = {r.id: r.overlaps for r in contracts.overlap_counts(spark.createDataFrame(rows, "id long, council string, supplier_canon string, start_date date, end_date date, is_tech int")).collect()}
    lo, hi = dt.date.min, dt.date.max
    assert got == {a[0]: sum(a[0] != b[0] and a[2] == b[2] and (b[3] or lo) <= (a[4] or hi) and (b[4] or hi) >= (a[3] or lo) for b in rows) for a in rows}


def test_day_month_against_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for f in range(12):
        style = "d"
        for n in range(40):
            if rng.random() < 0.1:
                style = "m" if style == "d" else "d"
            d = dt.date(2023, rng.randrange(1, 13), rng.randrange(1, 29))
            rows.append((f, n, d.strftime("%d/%m/%Y" if style == "d" else "%m/%d/%Y")))
    rows.append((0, 99, "13/13/2023"))

    def loop(file):
        cells = [(n, *map(int, t.split("/"))) for f, n, t in rows if f == file]
        cells = [c for c in cells if not (c[1] > 12 and c[2] > 12)]
        known = [("d", c[2]) if c[1] > 12 else ("m", c[1]) if c[2] > 12 else None for c in cells]
        out = {}
        for k, (n, a, b, y) in enumerate(cells):
            before = next((x for x in known[k::-1] if x), None)
            after = next((x for x in known[k:] if x), None)
            if known[k]:
                s = known[k][0]
            elif not before or not after or before[0] == after[0]:
                s = (before or after or ("d",))[0]
            else:
                month = lambda st: b if st == "d" else a
                s = before[0] if month(before[0]) == before[1] else after[0] if month(after[0]) == after[1] else before[0]
            m, d = (b, a) if s == "d" else (a, b)
            out[n] = dt.date(y, m, d)
        return out

    got = {}
    for r in ordered.resolve_day_month(spark.createDataFrame(rows, "file int, line int, date_text string")).collect():
        got.setdefault(r.file, {})[r.line] = r.date
    assert got == {f: loop(f) for f in range(12)}
    # The same with each file in many blocks, some without a telling row.
    for lines in (1, 3, 7):
        got = {}
        for r in ordered.resolve_day_month(spark.createDataFrame(rows, "file int, line int, date_text string"), block_lines=lines).collect():
            got.setdefault(r.file, {})[r.line] = r.date
        assert got == {f: loop(f) for f in range(12)}, lines


def test_lines_are_numbered_in_blocks(spark):
    rows = [(f, n) for f in "ab" for n in random.Random(f).sample(range(500), 60)]
    got = {(r.file, r.line): r.n for r in ordered.numbered(spark.createDataFrame(rows, "file string, line int"), "file", "line", "n", block_lines=40).collect()}
    assert got == {(f, n): k for f in "ab" for k, n in enumerate(sorted(n for g, n in rows if g == f))}


@pytest.mark.parametrize("radius", [60, 700, 9000])
def test_near_pairs_all_over_the_globe(spark, radius):
    """Poles, the date line and the end of a window: the same as from all pairs, and only neighbours meet."""
    rng = random.Random(radius)
    spots = [(rng.choice([rng.uniform(-90, 90), 89.95, -90.0, 51 + rng.random()]), rng.choice([rng.uniform(-180, 180), 179.99, -179.99, -1 + rng.random()])) for _ in range(150)]
    rows = [(p % 2, f"l{p:03}", dt.date(2024, 1, 1) + dt.timedelta(days=rng.choice([0, 182, 183, 365, rng.randrange(900)])), lat, lon) for p, (lat, lon) in enumerate(spots)]

    def km(a, b):
        x, y = math.radians(a[3]), math.radians(b[3])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and km(a, b) <= radius and abs((a[2] - b[2]).days) <= 6 * 30.4)
    out = clusters.near_pairs(spark.createDataFrame(rows, "product_id int, lad_code string, end_date date, lat double, lon double"), radius, 6)
    assert sorted((r.product_id, r.lad_a, r.lad_b) for r in out.collect()) == want and len(want) > 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_xb" in plan


def test_clusters_fit(spark, sf):
    import numpy as np

    rng = np.random.default_rng(4)
    near = rng.random((14, 14)) < 0.6
    near = near | near.T | np.eye(14, dtype=bool)
    for members in clusters._groups([np.flatnonzero(row).tolist() for row in near], lambda a, b: bool(near[a, b]), 2):
        assert all(near[a, b] for a in members for b in members)
    assert __spark_entry__.queries()["w09_clusters"](spark, "/root/testdata/sf0.01").where("n < 2").count() == 0


@pytest.mark.parametrize("mode", ["proximity", "authority"])
def test_clusters_against_a_loop(spark, mode):
    rng = random.Random(6)
    names = ["A", "B", "", None, "No current strategic authority"]
    rows = [(p, f"l{k:02}", dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(500)), float(rng.randrange(1, 9)) * 1e5, 50 + rng.random(), -1 + rng.random(), rng.choice(names)) for p in range(3) for k in range(16)]
    got = clusters.clusters(spark.createDataFrame(rows, "product_id long, lad_code string, end_date date, value double, lat double, lon double, combined_authority string"), spark.createDataFrame([(p, p + 1) for p in range(3)], "product_id long, councils int"), mode=mode).collect()

    def km(a, b):
        x, y = math.radians(a[4]), math.radians(b[4])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
        return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    fits = (lambda a, b: a[6] == b[6]) if mode == "authority" else (lambda a, b: km(a, b) <= 60)
    want = []
    for p in range(3):
        areas = sorted((r for r in rows if r[0] == p and (mode != "authority" or r[6] in ("A", "B"))), key=lambda r: (r[2], r[1]))
        found = {}
        for seed in areas:
            group = [r for r in areas if fits(seed, r) and abs((r[2] - seed[2]).days) <= 6 * 30.4]
            while len(group) > 1:
                bad = [sum(not fits(a, b) for b in group if b is not a) for a in group]
                if not max(bad):
                    break
                del group[bad.index(max(bad))]
            if len(group) >= 2:
                days, value = [r[2] for r in group], sum(r[3] for r in group)
                span = (max(days) - min(days)).days
                found.setdefault(frozenset(r[1] for r in group), (round(len(group) / (1 + span / 30.4) / math.log(2.718281828 + p + 1) * math.log(1 + value), 2), span, value))
        kept = []
        for m, (points, span, value) in sorted(found.items(), key=lambda x: -x[1][0]):
            if not any(m <= k or len(m & k) / len(m | k) >= 0.6 for k in kept):
                kept.append(m)
                want.append((p, ",".join(sorted(m)), len(m), span, value, points))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3 and (mode == "authority" or any(r[3] > 6 * 30.4 for r in want))


def test_trace_back(spark):
    stored = spark.createDataFrame([(1, 7, "Acme Ltd", 10.00), (2, 7, "Nobody", 10.00), (3, 7, "ACME", 10.06)], "id long, source_id long, supplier_raw string, amount double")
    source = spark.createDataFrame([(7, 5, "acme", 10.01), (7, 4, "Acme Limited", 10.0), (7, 3, "Acme", 10.05)], "source_id long, row_no int, supplier string, amount double")
    assert {r.id: r.row_no for r in contracts.trace_back(stored, source).collect()} == {1: 4, 2: None, 3: 3}


def test_trace_back_by_any_column(spark):
    stored = spark.createDataFrame([(1, 7, "Acme Ltd", 10.00), (2, 7, "Borders", 20.00), (3, 7, "  ", 30.00), (4, 7, "Corvid", -5.0)], "id long, source_id long, supplier_raw string, amount double")
    source = spark.createDataFrame(
        [(7, 2, " ", 10.0, [" ", "10.00"]), (7, 3, "Acme Limited", 10.0, ["Acme Limited", "10.00"]), (7, 5, "x", 0.0, ["x", "", "BORDERS plc", "£20.01"]), (7, 6, "x", 0.0, ["x", "", "Borders", "20"]), (7, 7, "y", 0.0, ["Corvid", "-5.00"]), (8, 1, "Borders", 20.0, ["Borders", "20.0"])],
        "source_id long, row_no int, supplier string, amount double, cells array<string>",
    )
    assert {r.id: r.row_no for r in contracts.trace_back(stored, source).collect()} == {1: 3, 2: 5, 3: None, 4: None}


def test_trace_back_takes_no_amount_for_a_name_nor_a_name_for_an_amount(spark, duck, tmp_path):
    """Orders 19 and 37: an amount starts with the digits that their payee starts with; the third: its amount is what the digits of order 4's payee make."""
    number = lambda k: k * 7919 % 1000003
    other = next(k for k in range(1, 10**6, 6) if str(number(k)).endswith(str(number(4))))
    rows = [(19, 5, float(f"{number(19)}.50")), (37, 6, float(f"{number(37)}.25")), (4, 3, 50.0), (other, 3, float(f"{number(4)}3"))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.row_no for r in __spark_entry__.queries()["j14_trace_back"](spark, str(tmp_path)).collect()}
    sql = __spark_entry__.oracle_sql()["j14_trace_back"]
    want = dict(duck.sql(f"WITH orders AS (FROM '{tmp_path}/orders.parquet/*.parquet') SELECT id, row_no FROM ({sql})").fetchall())
    assert got == want == {19: None, 37: None, 4: 4, other: None}
