"""Columns with dots, and with the names that operators use themselves."""

from ledgerlake.llm import pii, queries, url_filter


def test_urls_in_dotted_columns(spark):
    df = spark.createDataFrame([(1, "http://a.NET/x", 5), (1, "http://a.NET/x", 5), (None, None, 5)], "`page.id` long, `the.url` string, host int")
    got = url_filter.judge(df, queries.URL_RULES, id_col="page.id", url="the.url")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "a.net", "/x", "net/", "block")] * 2 + [(None, "", "", None, "allow")]))


def test_pseudonyms_beside_helper_names(spark):
    rows = [(1, "Write to ann@example.com now", "f", "n", 7, "r"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, `the.text` string, __found string, __new string, n_found int, row string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k" * 32, text="the.text").collect()}
    assert got[1]["the.text"] != rows[0][1] and (got[1]["__found"], got[1]["__new"], got[1]["row"], got[1]["n_found"]) == ("f", "n", "r", 1)
    assert got[2]["the.text"] is None and got[2]["n_found"] == 0
    back = pii.pseudonymise(spark.createDataFrame([tuple(got[1][c] for c in df.columns)], df.schema), "k" * 32, text="the.text", inverse=True).first()
    assert back["the.text"] == rows[0][1]
