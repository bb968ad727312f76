"""Benchmark decontamination against a plain loop, and on the odd cases."""

import hashlib
import random
import re

import pytest

from ledgerlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, window=10):
    """Every window of every item at every word of every document."""
    known = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for k in range(len(w)):
            for n in range(1, window + 1):
                if k + n <= len(w) and tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    names |= known[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c3", "é", "ÄB", "の", "x" * 70, "9"])
    say = lambda k: "".join(word() + rng.choice([" ", "\n", ", ", "--", "\x00", "`"]) for _ in range(k))
    items = [(k, say(rng.choice([0, 1, 3, 9, 10, 11, 40]) if k > 3 else 25)) for k in range(12)] + [(None, say(12)), (5, say(14)), (5, say(14)), (77, None), (78, "!!")]
    docs = [(k, say(rng.randrange(0, 60)) + (rng.choice(items)[1] or "") + say(rng.randrange(0, 9))) for k in range(n)]
    return docs + [(None, None), (3, ""), (3, ""), (4, items[0][1]), (4, items[0][1])], items


@pytest.mark.parametrize("seed,window,block", [(1, 10, 1 << 20), (2, 4, 1 << 20), (3, 10, 200), (4, 3, 400)])
def test_against_a_loop(spark, seed, window, block):
    docs, items = made(seed)
    # One-letter items would hit everything: they are kept for one seed only.
    items = [x for x in items if seed == 1 or len(words(x[1])) != 1]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n_hit int, `row.a` string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digests(d, i, window=window, block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, window)


def test_long_items_are_cut(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_BYTES", 40)
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(50))) for k in range(4)]
    docs = [(k, " ".join(words(items[k % 4][1])[k : k + 30])) for k in range(20)]
    got = decontam.digests(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Ünder: {item.upper()}! After.", "a"), (2, "nothing here", None), (3, None, "b"), (4, item + " / " + item, "c"), (5, "two three four five six seven eight nine ten", "d"), (6, "", "d")]
    d = spark.createDataFrame(docs, "doc_id long, text string, `so.urce` string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontam.decontaminated(d, i)
    assert out.columns == d.columns and {r[0]: (r[1], r[2]) for r in out.collect()} == {1: ("Ünder: ! After.", "a"), 2: ("nothing here", None), 3: (None, "b"), 4: ("", "c"), 5: (docs[4][1], "d"), 6: ("", "d")}
    assert sorted(r[0] for r in decontam.decontaminated(d, i, remove="documents").collect()) == [2, 3, 5, 6]
    assert sorted(r[0] for r in decontam.decontaminated(d, i, remove="documents", most=0.9).collect()) == [1, 2, 3, 5, 6]
    with pytest.raises(ValueError):
        decontam.decontaminated(d, i, remove="all")


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in decontam.digests(docs, items).collect()] == [(1, 2, 0, 0, nothing, False)]
    assert decontam.digests(docs.limit(0), items).count() == 0


def test_one_very_long_text(spark):
    item = " ".join(f"w{k}" for k in range(30))
    text = "filler " * 700_000 + item + " filler" * 10
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = decontam.digests(d, spark.createDataFrame([("q", item)], "item_id string, text string")).first()
    assert (r.n_words, r.n_hit, r.n_items) == (700_040, 30, 1)
