"""Queries over what comes in: payment files, procurement releases, the source catalogue; each with its oracle SQL.

The driver's rows are rendered as the bytes, lines and JSON that publishers
send, and read back by the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import dates, money
from ledgerlake.operators import notices
from ledgerlake.plans.fixtures import Inputs, duck
from ledgerlake.plans.registry import Registry
from ledgerlake.sources import files, ocds
from ledgerlake.streaming import incremental

R = Registry()
query = R.query


@query("""
SELECT o_orderkey, 'Customer, "No" ' || CAST(o_custkey AS VARCHAR) AS supplier, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS amount,
  CAST(o_orderdate AS DATE) AS paid_date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS service
FROM orders""")
def s01_payment_files(i: Inputs):
    """An order is a file of its own, in one of four encodings and two separators, with or without a service column."""
    sep = F.when(F.col("o_orderkey") % 3 == 0, "\t").otherwise(",")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    row = lambda *cells: F.array_join(F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells)), "\x01")
    amount = F.concat(F.lit("£"), F.format_number(F.col("o_totalprice").cast("decimal(14,2)"), 2))
    day = F.date_format(F.to_date("o_orderdate"), "dd/MM/yyyy")
    served = F.col("o_orderkey") % 2 == 0
    supplier = F.concat(F.lit('Customer, "No" '), F.col("o_custkey"))
    lines = F.concat_ws(
        "\x02", row("Payments", "over", "£500"), F.lit(" "),
        F.when(served, row("Payment Date", "Supplier  Name", "Net Amount", "Service Area")).otherwise(row("Supplier Name", "Net Amount", "Payment Date")),
        F.when(served, row(day, quoted(supplier), quoted(amount), F.col("o_orderpriority"))).otherwise(row(quoted(supplier), quoted(amount), day)), row("", "", ""),
    )
    text = F.replace(F.replace(lines, F.lit("\x01"), sep), F.lit("\x02"), F.when(F.col("o_orderkey") % 5 == 0, "\r").otherwise("\r\n"))
    codes = {0: "UTF-8", 1: "UTF-16", 2: "UTF-16LE", 3: "ISO-8859-1"}
    content = F.coalesce(*(F.when(F.col("o_orderkey") % 4 == k, F.encode(text, code)) for k, code in codes.items()))
    decoded = files.decode_files(i.orders.select(F.col("o_orderkey").alias("path"), content.alias("content")))
    data, headers = files.after_header(files.cells(files.lines(decoded)), ["supplier", "amount"])
    spec = i.spark.createDataFrame([("supplier", "supplier", "prefix"), ("amount", "amount", "substr"), ("date", "payment date", "exact"), ("service", "service", "substr")], "field string, text string, mode string")
    r = files.pick_columns(data, files.map_columns(headers, spec))
    return r.select(F.col("file").alias("o_orderkey"), "supplier", money.parse_amount_spend(F.col("amount")).cast("double").alias("amount"), dates.parse_date_spend(F.col("date")).alias("paid_date"), "service")


def _releases(i: Inputs):
    """Documents as releases, two of one process and day: rendered to JSON and read with the release schema."""
    n = F.col("doc_id")
    k = F.floor(n / 2)
    either = lambda by, *values: F.element_at(F.array(*(v if not isinstance(v, str | None) else F.lit(v).cast("string") for v in values)), (n % by + 1).cast("int"))
    value = lambda c, currency: F.struct(c.cast("double").alias("amount"), currency.alias("currency"))
    supplier = lambda c: F.struct(c.alias("name"))
    text = lambda c: F.lit(c).cast("string")
    document = lambda kind, url, said=None: F.struct(text(kind).alias("documentType"), (text(url) if url is None else F.concat(F.lit(url), n)).alias("url"), (text(said) if said is None else F.concat(F.lit(said), n)).alias("description"))
    documents = lambda *d: F.array(*d).cast("array<struct<documentType:string,url:string,description:string>>")
    named = F.array(supplier(F.lit("Ash")), supplier(F.concat(F.lit("Bay "), n % 5)), supplier(F.lit("Ash")))
    award = F.struct(either(3, "active", "cancelled", None).alias("status"), value(n % 6, F.when(n % 5 == 0, "SEK")).alias("value"), F.when(n % 16 != 0, named).alias("suppliers"))
    kept = either(8, F.lit(None), documents(document("other", "o")), documents(document("tenderNotice", "t")), documents(document("other", "o"), document("awardNotice", None), document("tenderNotice", "t")), documents(document("contractNotice", "c")), documents(), documents(document("other", None), document("plannedProcurementNotice", "pp")), documents(document(None, "u")))
    release = F.struct(
        F.concat(F.lit("r-"), k).alias("ocid"), F.when(n % 13 != 0, F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int")), F.lit("T09:30:00Z"))).alias("date"),
        F.array(either(8, "award", "tender", "planning", "other", "awardUpdate", "tenderAmendment", "planning", "other")).alias("tag"), F.when(n % 3 == 0, "Rel").alias("description"), F.struct(F.when(n % 10 != 0, F.col("source")).alias("name")).alias("buyer"),
        F.struct(F.when(n % 5 == 0, documents(document("plannedProcurementNotice", "p", "Plan "))).alias("documents")).alias("planning"),
        F.struct(
            F.when(n % 17 != 0, F.concat(F.lit("<b>"), "source", F.lit("</b>"))).alias("title"), F.when(n % 2 == 0, "Ten <i>x</i>").alias("description"), either(7, "Active", "withdrawn", None, "COMPLETE", "planned", "planning", "unsuccessful").alias("status"),
            F.when(n % 26 == 0, "2023-05-06T00:00:00Z").alias("datePublished"), value(n % 11, either(3, "EUR", "USD", None)).alias("value"), F.struct(F.concat((n % 50 + 10).cast("string"), F.lit("000000")).alias("id")).alias("classification"), kept.alias("documents"),
        ).alias("tender"),
        F.when(n % 4 == 0, F.array(award)).alias("awards"),
        F.when((n % 3 == 1) | (n % 11 == 0), F.array(F.struct(F.lit("C1").alias("title"), value(F.lit(3), F.lit("NOK")).alias("value")), F.struct(text(None).alias("title"), value(n % 13, F.when(n % 2 == 0, "DKK")).alias("value")))).alias("contracts"),
        F.array(F.struct(F.lit("Cob").alias("name"), F.array(F.lit("supplier")).alias("roles")), F.struct(F.lit("Dew").alias("name"), F.array(F.lit("buyer")).alias("roles"))).alias("parties"),
    )
    return i.documents.where("doc_id IS NOT NULL").select(F.from_json(F.to_json(release), ocds.SCHEMA).alias("r")).select("r.*")


#: What each release says, field by field; the rules for both kinds are applied below.
_SAID = """
WITH f AS (SELECT doc_id AS n, doc_id // 2 AS k, source AS buyer_name, doc_id % 4 = 0 AS awarded, doc_id % 3 = 1 OR doc_id % 11 = 0 AS contracted,
  ['active', 'withdrawn', NULL, 'complete', 'planned', 'planning', 'unsuccessful'][doc_id % 7 + 1] AS t, ['EUR', 'USD', NULL][doc_id % 3 + 1] AS tender_currency,
  CASE WHEN doc_id % 4 = 0 AND doc_id % 5 = 0 THEN 'SEK' END AS award_currency, CASE WHEN doc_id % 4 = 0 THEN nullif(doc_id % 6, 0) END AS award_amount, nullif(doc_id % 11, 0) AS tender_amount,
  CASE WHEN doc_id % 13 <> 0 THEN DATE '2024-01-01' + CAST(doc_id // 2 % 700 AS INT) END AS day, CASE WHEN doc_id % 17 <> 0 THEN source END AS tender_title, CASE WHEN doc_id % 2 = 0 THEN 'Ten x' END AS tender_text,
  CASE WHEN doc_id % 4 = 0 AND doc_id % 16 <> 0 THEN 'Ash | Bay ' || CAST(doc_id % 5 AS VARCHAR) END AS award_names, CAST(doc_id % 50 + 10 AS VARCHAR) AS cpv_division, CAST(doc_id AS VARCHAR) AS s
  FROM documents WHERE doc_id % 10 <> 0 AND source <> '')
"""
_SHOWN = ["ocid", "title", "description", "buyer_name", "stage", "status", "cast(value_amount AS double) AS value_amount", "value_currency", "cpv_division", "published_date", "official_url", "supplier_names"]


@query(_SAID + """SELECT 'r-' || CAST(k AS VARCHAR) AS ocid, coalesce(tender_title, CASE WHEN n % 5 = 0 THEN 'Plan ' || s END, '') AS title, coalesce(tender_text, '') AS description, buyer_name,
  CASE n % 4 WHEN 0 THEN 'award' WHEN 1 THEN 'tender' WHEN 2 THEN 'planning' ELSE 'active' END AS stage,
  CASE WHEN awarded THEN CASE WHEN n % 3 = 1 THEN 'cancelled' ELSE 'complete' END WHEN t IN ('active', 'planned', 'cancelled', 'complete') THEN t ELSE 'active' END AS status,
  CAST(coalesce(award_amount, tender_amount) AS DOUBLE) AS value_amount, coalesce(tender_currency, award_currency, 'GBP') AS value_currency, cpv_division,
  coalesce(day, CASE WHEN n % 26 = 0 THEN DATE '2023-05-06' END) AS published_date,
  CASE WHEN n % 8 = 2 THEN 't' || s WHEN n % 8 = 3 THEN NULL WHEN n % 8 = 6 THEN 'pp' || s WHEN n % 5 = 0 THEN 'p' || s END AS official_url, award_names AS supplier_names FROM f""")
def n01_flatten_releases(i: Inputs):
    return notices.flatten_releases(_releases(i)).selectExpr(*_SHOWN)


@query(_SAID + """SELECT 'r-' || CAST(k AS VARCHAR) AS ocid, coalesce(tender_title, CASE WHEN contracted THEN 'C1' END, '') AS title, coalesce(tender_text, CASE WHEN n % 3 = 0 THEN 'Rel' END, '') AS description, buyer_name,
  CASE WHEN awarded OR contracted THEN 'award' WHEN t IN ('planned', 'planning') THEN 'planning' ELSE 'tender' END AS stage,
  CASE t WHEN 'active' THEN 'active' WHEN 'planned' THEN 'planned' WHEN 'planning' THEN 'planned' WHEN 'complete' THEN 'complete' WHEN 'unsuccessful' THEN 'cancelled' WHEN 'withdrawn' THEN 'withdrawn'
    ELSE CASE WHEN awarded OR contracted THEN 'complete' ELSE 'active' END END AS status,
  CAST(CASE WHEN award_amount IS NOT NULL THEN award_amount WHEN tender_amount IS NOT NULL THEN tender_amount WHEN contracted THEN 3 + n % 13 END AS DOUBLE) AS value_amount,
  coalesce(CASE WHEN award_amount IS NOT NULL THEN award_currency WHEN tender_amount IS NOT NULL THEN tender_currency WHEN contracted THEN CASE WHEN n % 13 <> 0 AND n % 2 = 0 THEN 'DKK' ELSE 'NOK' END END, 'GBP') AS value_currency,
  cpv_division, day AS published_date, CASE n % 8 WHEN 1 THEN 'o' || s WHEN 2 THEN 't' || s WHEN 3 THEN 'o' || s WHEN 4 THEN 'c' || s WHEN 6 THEN 'pp' || s WHEN 7 THEN 'u' || s END AS official_url,
  coalesce(award_names, 'Cob') AS supplier_names, 'Wales' AS region FROM f""")
def n02_flatten_compiled(i: Inputs):
    return notices.flatten_compiled(_releases(i), "Wales").selectExpr(*_SHOWN, "region")


@query(duck("spend sources", "SELECT CAST(s.id AS BIGINT) AS id, s.council, s.period, CAST(coalesce(n, s.last_count) AS BIGINT) AS last_count FROM sources s LEFT JOIN (SELECT council, period, count(*) AS n FROM spend WHERE line = 1 GROUP BY 1, 2) p ON p.council = s.council AND p.period = s.period"))
def i01_record_counts(i: Inputs):
    """The first lines of orders are what was just read; other sources keep their counts."""
    rows = i.spend.where("line = 1").join(i.sources.select(F.col("id").alias("source_id"), "council", "period"), ["council", "period"]).select("source_id")
    return incremental.record_counts(i.sources, rows).select(F.col("id").cast("long").alias("id"), "council", "period", F.col("last_count").cast("long").alias("last_count"))


@query(duck("sources", "SELECT CAST(id AS BIGINT) AS id, council, period FROM sources WHERE active = 1 AND last_count IS NULL"))
def i01_never_imported(i: Inputs):
    return incremental.never_imported(i.sources).select(F.col("id").cast("long").alias("id"), "council", "period")
