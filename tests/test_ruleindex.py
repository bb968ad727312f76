"""The index over rules against every rule on every name."""

import random
import re
import time

from pyspark.sql import functions as F

import __spark_entry__
from ledgerlake.operators import match, ruleindex

KIND = "id int, pattern string, canonical_name string, match_type string, confirmed_invalid int"
WORDS = "alpha beta gamma delta it ict system systems consult soft ware north south red blue steel bolt gear x1 o'hare a.b c++ café".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(seed, names=300, rules=60):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shapes = [lambda: say(1), lambda: say(2), lambda: rng.choice(WORDS)[:2], lambda: rng.choice("abx"), lambda: say(1)[1:5]]
    regex = [lambda: "gears?", lambda: r"s(oft|teel)\s+\w+", lambda: "alpha|beta", lambda: "de.ta", lambda: "[abc]lpha", lambda: "gam{2}a", lambda: "syst(em)?s?", lambda: "no+rth", lambda: r"a\.b", lambda: "(red|blue) (bolt|gear)", lambda: "i[ct]+", lambda: "x?", lambda: "consult(?!ing)", lambda: "(?:so(u|f)t)h?|ware"]
    out = []
    for k in range(rules):
        word = rng.random() < 0.5
        out.append((k, (rng.choice(regex) if word else rng.choice(shapes))().upper() if not word and rng.random() < 0.2 else (rng.choice(regex) if word else rng.choice(shapes))(), rng.choice(["", f"C{k}", f"C{k}"]), "word_boundary" if word else "substring", int(rng.random() < 0.2)))
    return [(f" {say(rng.randrange(0, 6))}{rng.choice(['', ' Redacted', 'É'])} ",) for _ in range(names)] + [(None,), ("",)], out


def brute(names, rules, mode):
    out = {}
    for (name,) in names:
        if name is None:
            continue
        key = name.strip(" ").lower()
        if mode == "payments":
            key = key.translate(str.maketrans("àáâãäåèéêëìíîïòóôõöùúûüçñ", "aaaaaaeeeeiiiiooooouuuucn"))
        found = []
        for k, p, canon, kind, invalid in rules:
            if invalid and mode != "authority":
                continue
            p = p.lower()
            literal = mode == "reclassify"
            hit = re.search(rf"\b(?:{re.escape(p) if literal else p})\b", key) if kind == "word_boundary" else p in key
            if hit:
                found.append((kind != "word_boundary", k, canon))
        canon = min(found)[2] if found and not (mode in ("register", "reclassify") and "redacted" in key) else None
        out[name] = canon or None
    return out


def test_equal_to_every_rule_on_every_name(spark):
    for seed in (1, 2):
        names, rules = made(seed)
        df, r = spark.createDataFrame(names, "supplier_raw string"), spark.createDataFrame(rules, KIND)
        for mode in ("payments", "register", "authority", "reclassify"):
            got = match.match_supplier(df, r, mode=mode)
            assert dict(map(tuple, got.collect())) == brute(names, rules, mode), (seed, mode)
            assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_demanded_texts(spark):
    cases = {"gears?": ["gear"], "alpha|be": ["alpha", "be"], r"soft\s+ware": ["soft"], "(abc)+def": ["def"], "a{3}bcd": ["bcd"], "[xyz]abc": ["abc"], "((a|b)c)d": ["d"], "": [""], "ab+cd": ["ab"], r"x\.yz1": ["yz1"], "a(b": [""]}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", ruleindex.demanded(F.col("p"))).collect()
    assert dict(map(tuple, got)) == cases


def test_rulings(spark):
    rows = [("Acme Temps", "Agency staff", "Care"), ("Acme Temps", "Other", "IT"), ("Beta", None, "agency"), (None, "agency", None), ("acme x", "Agency", None), ("Zz", None, None)]
    df = spark.createDataFrame(rows, "supplier_canon string, service string, category string")
    out = match.apply_exclusions(df, spark.createDataFrame([("acme", "agency"), ("ET", "AGENCY"), ("zz", "zz")], "supplier_pattern string, service_keyword string"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[1], rows[3], rows[5]]))
    out = match.drop_invalid_services(df, spark.createDataFrame([("STAFF", "invalid"), ("it", "valid"), ("o", "invalid")], "keyword string, ruling string"))
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(r) for r in rows if not r[1] or "staff" not in r[1].lower() and "o" not in r[1].lower())
    out = match.drop_invalid_suppliers(df, spark.createDataFrame([(1, "acm", "", "substring", 1), (2, "zz", "", "substring", 0)], KIND))
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(r) for r in rows if "acm" not in (r[0] or "").lower()) and "NestedLoop" not in plan(out)


def test_reclassified_as_by_a_full_rematch(spark):
    rng = random.Random(5)
    names, rules = made(7, 400, 60)
    rules = [r for r in rules if r[3] == "substring" or "(" not in r[1]]
    new = [r for r in rules if rng.random() < 0.85]
    new = [(*r[:2], r[2] + "!", *r[3:]) if rng.random() < 0.1 else (*r[:4], 1 - r[4]) if rng.random() < 0.1 else r for r in new] + [(900, "north", "Fresh", "word_boundary", 0)]
    was, now = brute(names, rules, "reclassify"), brute(names, new, "reclassify")
    barred = lambda k: k % 7 == 0
    entries, want = [], {}
    for k, (name,) in enumerate(names):
        if name is not None:
            old_tech, tech = int(was[name] is not None and not barred(k)), int(now[name] is not None and not barred(k))
            held = was[name] if old_tech else name[:300]
            entries.append((k, name, "A promo" if barred(k) else None, was[name], old_tech, held))
            canon = now[name] if tech else name[:300]
            want[k] = (canon, tech, "to tech" if tech > old_tech else "from tech" if tech < old_tech else "canon only" if canon != held else "unchanged")
    df = spark.createDataFrame(entries, "id int, supplier string, contract_title string, matched string, is_tech int, supplier_canon string")
    out = match.reclassified(df, spark.createDataFrame(rules, KIND), spark.createDataFrame(new, KIND), ["promo"])
    assert {r.id: (r.new_canon, r.new_tech, r.change) for r in out.collect()} == want
    assert {w[2] for w in want.values()} == {"to tech", "from tech", "canon only", "unchanged"}


def unordered(df):
    """The rows of ``df``, in another order each time they are read, as after a shuffle between executors."""

    def run(batches):
        import os

        import pyarrow as pa

        rows = pa.Table.from_batches(list(batches))
        yield from rows.take(pa.array(random.Random(os.urandom(8)).sample(range(rows.num_rows), rows.num_rows), pa.int64())).to_batches()

    return df.coalesce(1).mapInArrow(run, df.schema)


def test_rules_that_come_in_another_order_each_time(spark, sf, duck, monkeypatch):
    words = [(k, f"{a}{b}", f"C{k}", "substring", 0) for k, (a, b) in enumerate((a, b) for a in ("red", "blue", "steel", "gear") for b in ("wing", "lamp", "mouse", "tank", "ship"))]
    names = spark.createDataFrame([(f"the {p} co",) for _, p, *_ in words], "supplier_raw string")
    got = match.match_supplier(names, unordered(spark.createDataFrame(words, KIND)), mode="reclassify")
    assert dict(map(tuple, got.collect())) == {f"the {p} co": canon for _, p, canon, *_ in words}

    changed = match.changed_rules
    monkeypatch.setattr(match, "changed_rules", lambda old, new: unordered(changed(old, new)))
    out = __spark_entry__.queries()["r11_reclassify"](spark, sf).select("id", "new_canon", "new_tech", "change").collect()
    assert sorted(map(tuple, out)) == sorted(duck.sql(f"SELECT id, new_canon, new_tech, change FROM ({__spark_entry__.oracle_sql()['r11_reclassify']})").fetchall())


def test_many_names_and_rules_in_seconds(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(4000)]
    names = spark.createDataFrame([(" ".join(rng.choice(vocabulary) for _ in range(4)) + f" {k}",) for k in range(50_000)], "supplier_raw string").cache()
    rules = spark.createDataFrame([(k, rng.choice(vocabulary) + " " * 0, f"C{k}", "word_boundary", 0) for k in range(400)], KIND).cache()
    names.count(), rules.count()
    match.match_supplier(names.limit(10), rules).collect()
    began = time.time()
    assert match.match_supplier(names, rules).where("supplier_canon IS NOT NULL").count() > 10_000
    took = time.time() - began
    print("50,000 names, 400 rules:", took)
    assert took < 30
