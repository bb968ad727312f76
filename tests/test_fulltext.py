"""The full-text index against a look at every text."""

import random
import re

from ledgerlake.operators import fulltext


def test_index(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = "north Northern norther nor ltd UK uk_gov café cafe the the the of zz 日本 x1".split()
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    rows = [(k, rng.choice([None, "", say(3)]), say(rng.randrange(0, 12))) for k in range(300)] + [(7, "again north of", "the")]
    fulltext.build_index(spark.createDataFrame(rows, "k long, title string, body string"), "k", ["title", "body"], str(tmp_path / "i"))
    index = fulltext.open_index(spark, str(tmp_path / "i"))
    split = [(k, [re.findall(r"\w+", (t or "").lower().replace("é", "e")) for t in texts]) for k, *texts in rows]

    def ids(df):
        return sorted(r.id for r in df.collect())

    def has(test):
        return sorted({k for k, fields in split if any(test(w) for w in fields)})

    holds = lambda *p: lambda w: any(tuple(w[i : i + len(p)]) == p for i in range(len(w)))
    assert ids(fulltext.word(index, "North")) == has(holds("north")) and ids(fulltext.word(index, "nowhere")) == []
    assert ids(fulltext.prefix(index, "north")) == has(lambda w: any(x.startswith("north") for x in w))
    for p in (("the", "the"), ("of", "the", "uk"), ("the", "of", "the"), ("日本", "x1")):
        assert ids(fulltext.phrase(index, list(p))) == has(holds(*p)), p
    assert ids(fulltext.any_phrase(index, [["uk", "ltd"], ["ltd", "uk"], ["cafe"]])) == has(lambda w: holds("uk", "ltd")(w) or holds("ltd", "uk")(w) or "cafe" in w)
    assert ids(fulltext.every([fulltext.word(index, "of"), fulltext.prefix(index, "nor")])) == sorted({k for k, f in split if any("of" in w for w in f)} & set(has(lambda w: any(x.startswith("nor") for x in w))))
    title = fulltext.open_index(spark, str(tmp_path / "i"), ["title"])
    assert ids(fulltext.word(title, "zz")) == sorted({k for k, (t, _) in split if "zz" in t})
    plan = fulltext.prefix(index, "north")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,north)" in plan and "LessThan(term,norti)" in plan and "body" not in plan


def test_empty(spark, tmp_path):
    fulltext.build_index(spark.createDataFrame([(1, None)], "k long, t string"), "k", ["t"], str(tmp_path / "i"))
    assert fulltext.phrase(fulltext.open_index(spark, str(tmp_path / "i")), ["a", "b"]).count() == 0
