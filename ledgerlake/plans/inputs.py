"""Queries over pages, scalar parsing and queues; each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import dates, geo, money, text
from ledgerlake.operators import ordered
from ledgerlake.plans.fixtures import Inputs, duck
from ledgerlake.plans.registry import Registry
from ledgerlake.sources import html, sinks

R = Registry()
query = R.query


def _text_sql() -> str:
    text = f"regexp_replace(regexp_replace(html, '{html.UNSEEN}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, char in html.ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return f"SELECT page_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS text FROM pages"


@query(_text_sql())
def s08_html_text(i: Inputs):
    return i.pages.select("page_id", html.html_text(F.col("html")).alias("text"))


@query(duck("spend", "SELECT council, count(*) AS n FROM spend WHERE council <> 'NATION_1' GROUP BY 1 UNION ALL SELECT 'NATION_1', count(*) FROM spend WHERE council = 'NATION_1' AND line = 1"))
def s11_replace_scope(i: Inputs):
    new = i.spend.where("council = 'NATION_1' AND line = 1")
    return sinks.replace_scope(i.spend, new, ["council"]).groupBy("council").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 18) + 1 AS BIGINT) AS shard FROM orders WHERE o_orderstatus <> 'F'")
def s14_shard(i: Inputs):
    return sinks.shard(i.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("dead")), ["o_orderkey"], dead="dead").select("o_orderkey", F.col("shard").cast("long").alias("shard"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS slashed, CAST(o_orderdate AS DATE) AS serial, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS named FROM orders")
def x10_parse_dates(i: Inputs):
    d = F.to_date("o_orderdate")
    # Serials below 40000 (mid 2009) are no dates, so the serial is moved 20 years on and back.
    serial = (F.datediff(d, F.lit(dates.SERIAL_DAY_0).cast("date")) + 7305).cast("string")
    named = F.when(F.col("o_orderkey") % 7 == 0, F.lit("31-Feb-1996")).otherwise(F.date_format(d, "dd-MMM-yyyy"))
    return i.orders.select("o_orderkey", dates.parse_date_spend(F.date_format(d, "dd/MM/yyyy")).alias("slashed"), F.date_sub(dates.parse_date_spend(serial), 7305).alias("serial"), dates.parse_date_spend(named).alias("named"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS plain, CAST(-CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS negative, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS register FROM orders")
def x05_parse_amounts(i: Inputs):
    t = F.format_number(F.col("o_totalprice").cast("decimal(14,2)"), 2)
    return i.orders.select("o_orderkey", money.parse_amount_spend(F.concat(F.lit("£"), t)).cast("double").alias("plain"), money.parse_amount_spend(F.concat(F.lit("-£"), t)).cast("double").alias("negative"), money.parse_amount_register(F.concat(F.lit("£"), t, F.lit(" (incl. VAT) per annum"))).cast("double").alias("register"))


@query(duck("spend", "SELECT DISTINCT period, CAST(CAST(substr(period, 1, 4) AS INT) - CASE WHEN CAST(substr(period, 6, 2) AS INT) < 4 THEN 1 ELSE 0 END AS INT) AS fy, CAST(CAST(substr(period, 1, 4) AS INT) * 12 + CAST(substr(period, 6, 2) AS INT) - 1 AS INT) AS idx, period AS again FROM spend"))
def x15_periods(i: Inputs):
    p = F.col("period")
    return i.spend.select("period").distinct().select("period", dates.fy_from_period(p).alias("fy"), dates.month_index(p).alias("idx"), dates.month_of_index(dates.month_index(p)).alias("again"))


@query(duck("geo", "SELECT a.lad_code AS lad_a, b.lad_code AS lad_b, round(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (SELECT a.lad_code, b.lad_code AS lb, pow(sin(radians(CAST(b.lat - a.lat AS DOUBLE)) / 2), 2) + cos(radians(CAST(a.lat AS DOUBLE))) * cos(radians(CAST(b.lat AS DOUBLE))) * pow(sin(radians(CAST(b.lon - a.lon AS DOUBLE)) / 2), 2) AS h FROM geo a JOIN geo b ON a.lad_code < b.lad_code) a JOIN geo b ON b.lad_code = a.lb"))
def x20_haversine(i: Inputs):
    a, b = i.geo, i.geo.select(F.col("lad_code").alias("lad_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    d = lambda c: F.col(c).cast("double")
    return a.join(b, F.col("lad_code") < F.col("lad_b")).select(F.col("lad_code").alias("lad_a"), "lad_b", F.round(geo.haversine_km(d("lat"), d("lon"), d("lat_b"), d("lon_b")), 4).alias("km"))


@query(duck("config", "SELECT council, substr(lad_code, 1, 1) AS prefix, CASE substr(lad_code, 1, 1) WHEN 'E' THEN 'England' WHEN 'S' THEN 'Scotland' WHEN 'W' THEN 'Wales' WHEN 'N' THEN 'Northern Ireland' END AS nation, left(region, 5) || CASE WHEN length(region) > 6 THEN '…' ELSE substr(region, 6, 1) END AS short FROM config"))
def x18_nations(i: Inputs):
    p = text.nation_prefix(F.col("lad_code"))
    return i.config.select("council", p.alias("prefix"), text.nation_name(p).alias("nation"), text.truncate(F.col("region"), 6).alias("short"))


@query(duck("spend", "SELECT service, CAST(sum(CASE WHEN upper(service) = service THEN 1 ELSE 0 END) AS BIGINT) AS n, 'Known ' || lower(service) AS name FROM spend GROUP BY service"))
def x23_name_dictionary(i: Inputs):
    words = i.part.select(F.upper("p_type").alias("variant"), F.concat(F.lit("Known "), F.lower("p_type")).alias("name")).distinct()
    rows = text.normalise_name(i.spend.select("service", F.col("service").alias("name")), words, "name")
    return rows.groupBy("service", "name").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_custkey AS file, o_orderkey AS line, CAST(o_orderdate AS DATE) AS d, o_custkey % 2 = 0 AS us FROM orders), t AS (SELECT *, day(d) > 12 AS tells FROM r)
SELECT file, count(*) AS n, count(*) FILTER (WHERE tells) AS right_dates FROM t GROUP BY 1""")
def w01_day_month(i: Inputs):
    d = F.to_date("o_orderdate")
    rows = i.orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), d.alias("d"), F.when(F.col("o_custkey") % 2 == 0, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")).alias("date_text"))
    out = ordered.resolve_day_month(rows)
    return out.groupBy("file").agg(F.count("*").alias("n"), F.count_if((F.dayofmonth("d") > 12) & (F.col("date") == F.col("d"))).alias("right_dates"))

