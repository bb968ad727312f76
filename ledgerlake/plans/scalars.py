"""Queries over single rules of cleaning, dates, filters and sources; each renders the driver's rows as they would come in.

The SQL says what the rule makes of the value that was rendered, not how it reads it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import dates, money, text
from ledgerlake.operators import contracts, filters, notices, ordered
from ledgerlake.operators import clusters as K
from ledgerlake.plans.fixtures import AS_OF, Inputs, duck
from ledgerlake.plans.registry import Registry
from ledgerlake.sources import files, html, sinks, store
from ledgerlake.sources.scratch import scratch
from ledgerlake.streaming import incremental

R = Registry()
query = R.query

E = "CAST(o_orderdate AS DATE)"


def _d():
    return F.to_date("o_orderdate")


def _k():
    return F.col("o_orderkey")


# --- text -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'Ab ' || o_orderpriority || ' é' END AS clean, CASE WHEN o_orderkey % 5 <> 0 THEN 'ab ' || lower(o_orderpriority) || ' e' END AS folded FROM orders")
def x01_clean_text(i: Inputs):
    raw = F.when(_k() % 5 == 0, " \t\x00\x7f ").otherwise(F.concat(F.lit("\tAb\n \x01"), "o_orderpriority", F.lit("\x00  é ")))
    clean = text.sanitise(raw)
    return i.orders.select("o_orderkey", clean.alias("clean"), text.fold_key(clean).alias("folded"))


@query(r"SELECT doc_id, left(regexp_replace(regexp_replace('T ' || coalesce(text, ''), '<[^>]*>', '', 'g'), '[\x{10000}-\x{10FFFF}]', '', 'g'), 60) AS plain FROM documents")
def x04_strip_tags(i: Inputs):
    return i.documents.select("doc_id", text.strip_tags(F.concat(F.lit("<p class=x>T</p>🙂 "), F.coalesce("text", F.lit(""))), 60).alias("plain"))


@query(duck("config", "SELECT council, CASE WHEN nk % 4 > 0 THEN council || ' Ltd' || CASE WHEN nk % 4 > 1 THEN ' / B & C ' || CAST(nk AS VARCHAR) ELSE '' END END AS names FROM config"))
def x24_labelled_names(i: Inputs):
    nk = F.col("nk")
    one, two = F.concat(F.lit("Lot 1\r\nCompany name:  "), "council", F.lit(" Ltd \r\nTown: X\n")), F.concat(F.lit("company NAME: B & C "), nk.cast("string"), F.lit("\n"))
    return i.config.select("council", text.labelled_names(F.when(nk % 4 == 0, "no name here").when(nk % 4 == 1, one).otherwise(F.concat(one, two))).alias("names"))


@query(duck("config", "SELECT council, CASE WHEN nk % 3 > 0 THEN CAST(2020 + nk % 9 AS INT) END AS year, CASE nk % 5 WHEN 0 THEN 'tbd' WHEN 1 THEN 'proposed' ELSE CASE WHEN nk % 2 = 0 THEN 'live' ELSE 'proposed' END END AS status, CASE WHEN nk % 2 = 0 THEN 'Yorkshire and the Humber' ELSE region END AS label FROM config"))
def x22_lineage_names(i: Inputs):
    """X22 and X26."""
    nk = F.col("nk")
    name = F.concat("council", F.when(nk % 3 > 0, F.concat(F.lit(" from "), (2020 + nk % 9).cast("string"))).otherwise(" from 19999"), F.when(nk % 5 == 0, " (TBD, proposed)").when(nk % 5 == 1, " Proposed body").otherwise(""))
    region = F.when(nk % 2 == 0, F.when(nk % 4 == 0, " Yorkshire and The Humber").otherwise("YORKSHIRE AND THE HUMBER ")).otherwise(F.concat(F.lit(" "), "region"))
    return i.config.select("council", text.lineage_year(name).alias("year"), text.lineage_status(name, nk % 2 == 0).alias("status"), text.region_label(region).alias("label"))


# --- amounts --------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS repaired, CASE WHEN o_orderkey % 4 > 0 THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) END AS absolute,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) END AS authority FROM orders""")
def x06_amount_options(i: Inputs):
    """A space for the point; X7: debits published as negatives; X8: a minus behind the number, zero and below dropped."""
    total = F.col("o_totalprice").cast("decimal(14,2)")
    spaced = F.replace(total.cast("string"), F.lit("."), F.lit(" "))
    signed = F.when(_k() % 4 == 0, "£0.00").when(_k() % 4 == 1, F.concat(F.lit("-"), total.cast("string"))).otherwise(total.cast("string"))
    behind = F.when(_k() % 3 == 0, F.when(_k() % 2 == 0, F.concat(total.cast("string"), F.lit("-"))).otherwise("0")).otherwise(F.format_number(total, 2))
    return i.orders.select(
        "o_orderkey", money.parse_amount_spend(spaced, repair=True).cast("double").alias("repaired"), money.parse_amount_spend(signed, absolute=_k() % 4 >= 0).cast("double").alias("absolute"), money.parse_amount_authority(behind).cast("double").alias("authority"),
    )


# --- dates ----------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 AND month({E} + 10000) = 2 AND day({E} + 10000) = 29 THEN NULL ELSE {E} + 10000 END AS day FROM orders")
def x11_date_styles(i: Inputs):
    """Days of 2019 to 2025, in each source's own way; the last day of a leap February does not exist in the year before."""
    d, by = F.date_add(_d(), 10000), _k() % 6
    style = F.element_at(F.array(*map(F.lit, ("month_first", "epoch2000", "day_month", "slash_iso", "year_bump", "plain"))), (by + 1).cast("int"))
    since = F.datediff(d, F.lit("1999-12-31").cast("date")) - 1
    before = F.concat(F.date_format(d, "dd/MM/"), (F.year(d) - 1).cast("string"))
    shown = F.when(by == 0, F.date_format(d, "M/d/yyyy")).when(by == 1, (since + 1).cast("string")).when(by == 2, F.date_format(d, "d-MMM")).when(by == 3, F.concat(F.date_format(d, "yyyy/MM/dd"), F.lit(" 00:00:00+00"))).when(by == 4, before).otherwise(F.date_format(d, "dd/MM/yy"))
    return i.orders.select("o_orderkey", dates.parse_date_styled(shown, style, F.date_format(d, "yyyy-MM")).alias("day"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(make_date(year({E}), month({E}), 1) AS DATE) + 30 WHEN 1 THEN make_date(year({E}) + 1, 1, CAST(day({E}) AS BIGINT))
  WHEN 3 THEN NULL ELSE {E} END AS day FROM orders""")
def x12_register_dates(i: Inputs):
    """Day 31 of any month and month 13 roll forward; ordinals are read; the year 1850 is no date."""
    d, by = _d(), _k() % 5
    th = F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMM yyyy"))
    shown = F.when(by == 0, F.concat(F.lit("31/"), F.date_format(d, "MM/yyyy"))).when(by == 1, F.concat(F.date_format(d, "dd"), F.lit("/13/"), F.date_format(d, "yyyy"))).when(by == 2, th).when(by == 3, "01/02/1850").otherwise(F.date_format(d, "yyyy-MM-dd'T'00:00:00"))
    return i.orders.select("o_orderkey", dates.parse_date_register(shown).alias("day"))


@query(f"SELECT o_orderkey, {E} AS swapped, CASE WHEN o_orderkey % 4 > 0 THEN {E} WHEN o_orderkey % 8 = 0 THEN CAST(date_trunc('month', {E}) AS DATE) END AS filled FROM orders")
def x13_period_repairs(i: Inputs):
    """Day and month the wrong way round; X14: the first of the period for flagged sources."""
    d, period = _d(), F.date_format(_d(), "yyyy-MM")
    wrong = F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d))).otherwise(d)
    return i.orders.select("o_orderkey", dates.swap_into_period(wrong, period).alias("swapped"), dates.fallback_to_period(F.when(_k() % 4 > 0, d), period, _k() % 8 == 0).alias("filled"))


@query(f"SELECT DISTINCT {E} AS day, make_date(CAST(fy AS BIGINT), 4, 1) AS fy_from, make_date(CAST(fy + 1 AS BIGINT), 3, 31) AS fy_to, strftime(CAST(date_trunc('month', {E}) AS DATE) - 1, '%Y-%m') AS last_month FROM (SELECT *, year({E}) - CASE WHEN month({E}) < 4 THEN 1 ELSE 0 END AS fy FROM orders) o")
def x16_year_ranges(i: Inputs):
    low, high = dates.fy_range(dates.fy_from_date(F.col("day")))
    return i.orders.select(_d().alias("day")).distinct().select("day", low.alias("fy_from"), high.alias("fy_to"), dates.last_complete_month(F.col("day")).alias("last_month"))


# --- filters --------------------------------------------------------------------------------


@query(duck("spend", """
SELECT nk * 10 + m AS source_id, okey, line, count(*) AS n FROM spend, (VALUES (1, '1995-01'), (2, '1995-02'), (3, '1996-07')) v(m, p)
WHERE nk % 2 = 0 AND strftime(paid_date, '%Y-%m') = p OR nk % 2 = 1 AND m = 1 GROUP BY 1, 2, 3"""))
def f07_shared_files(i: Inputs):
    """Even bodies publish one file for three periods, odd ones a file of their own; each source reads its whole file."""
    months = i.spark.createDataFrame([(1, "1995-01"), (2, "1995-02"), (3, "1996-07")], "m int, period string")
    sources = i.config.join(F.broadcast(months), (F.col("nk") % 2 == 0) | (F.col("m") == 1)).select((F.col("nk") * 10 + F.col("m")).cast("long").alias("source_id"), F.concat(F.lit("u"), "nk").alias("url"), "period", F.col("nk").cast("long").alias("_nk"))
    rows = i.spend.join(F.broadcast(sources.select("source_id", "_nk")), F.col("nk") == F.col("_nk")).select("source_id", "okey", "line", "paid_date")
    return filters.period_of_shared_files(rows, sources.drop("_nk")).groupBy("source_id", "okey", "line").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 6 = 0")
def f09_plausible_names(i: Inputs):
    k = F.col("p_partkey") % 6
    name = F.when(k == 1, "x").when(k == 2, " Supplier NAME ").when(k == 3, "N/A").when(k == 4, "Cell content exceeds data limits").when(k == 0, F.col("p_name"))
    return i.part.select("p_partkey", name.alias("name")).where(filters.plausible_name(F.col("name")))


@query(duck("notices", "SELECT ocid FROM notices WHERE doc_id % 3 = 1 AND doc_id % 2 = 0 AND cpv_division = '48'"))
def f12_stage_and_source(i: Inputs):
    n = F.col("doc_id")
    rows = i.notices.withColumns({"stage": F.when(n % 3 == 1, "award").otherwise("tender"), "source": F.when(n % 2 == 0, "fts").otherwise("other")})
    return rows.where(filters.notice_filter(stage="award", source="fts", cpv="48")).select("ocid")


@query(duck("entries", f"SELECT id, end_date FROM entries WHERE is_tech = 1 AND end_date >= DATE '{AS_OF}' - INTERVAL 3 MONTH AND end_date < DATE '{AS_OF}'"))
def f15_expired(i: Inputs):
    return filters.expired(i.entries, F.lit(AS_OF).cast("date")).select("id", "end_date")


@query(duck("entries", "SELECT id FROM entries WHERE start_date >= DATE '1995-01-15' AND start_date <= DATE '1995-06-30'"))
def f16_awarded(i: Inputs):
    return i.entries.where(filters.awarded("1995-01-15", "1995-06-30")).select("id")


# --- registers, lineage, areas --------------------------------------------------------------


@query(duck("config", f"""
SELECT council FROM (SELECT council, nk, CASE nk % 4 WHEN 0 THEN 45 WHEN 1 THEN 120 WHEN 2 THEN 400 ELSE 120 END AS days, CASE WHEN nk % 7 > 0 THEN DATE '{AS_OF}' - CAST(nk * 20 AS INT) END AS fetched FROM config) c
WHERE nk % 6 > 0 AND (fetched IS NULL OR DATE '{AS_OF}' - fetched > days)"""))
def w03_stale_registers(i: Inputs):
    nk, day = F.col("nk"), F.lit(AS_OF).cast("date")
    note = F.element_at(F.array(F.lit("Monthly"), F.lit("each QUARTER"), F.lit("annually"), F.lit(None).cast("string")), (nk % 4 + 1).cast("int"))
    registers = i.config.select("council", F.when(nk % 6 > 0, 1).otherwise(0).alias("active"), note.alias("note"), F.when(nk % 7 > 0, F.date_sub(day, (nk * 20).cast("int"))).alias("last_fetched"))
    return ordered.stale_registers(registers, day).select("council")


@query(duck("config", """
WITH s AS (SELECT CASE WHEN nk % 3 = 0 AND lad_code <> '' THEN council ELSE 'New ' || CAST(nk % 7 AS VARCHAR) END AS succ_name, CASE WHEN nk % 3 = 0 AND lad_code <> '' THEN lad_code END AS code FROM config)
SELECT DISTINCT succ_name, coalesce(code, 'LGR' || lpad(CAST(n AS VARCHAR), 6, '0')) AS succ_key FROM s LEFT JOIN (SELECT succ_name, row_number() OVER (ORDER BY succ_name) AS n FROM (SELECT DISTINCT succ_name FROM s WHERE code IS NULL) d) m USING (succ_name)"""))
def w06_minted_keys(i: Inputs):
    nk = F.col("nk")
    own = (nk % 3 == 0) & (F.col("lad_code") != "")
    names = i.config.select(F.when(own, F.col("council")).otherwise(F.concat(F.lit("New "), (nk % 7).cast("string"))).alias("succ_name")).distinct()
    return contracts.mint_successor_keys(names, i.config)


@query(duck("notices config", """
WITH n AS (SELECT *, doc_id % 25 AS k FROM notices), r AS (SELECT n.*, CASE WHEN k IN (3, 4) THEN NULL WHEN k = 7 THEN (SELECT lad_code FROM config WHERE nk = 8) ELSE nullif(c.lad_code, '') END AS area FROM n JOIN config c ON c.nk = n.k)
SELECT area AS buyer_lad_code, count(*) AS notices, CAST(sum(value_amount) AS DOUBLE) AS value, min(published_date) AS earliest, max(published_date) AS latest FROM r WHERE area IS NOT NULL AND cpv_division IN ('30','32','48','64','72','73') GROUP BY 1"""))
def a36_area_notices(i: Inputs):
    """Buyers named in several ways; two names stand for more than one area, one is an alias of another body."""
    k = F.col("doc_id") % 25
    name = F.concat(F.element_at(F.array(*map(F.lit, ("The Nation {} Council", "NATION-{}", "nàtion {} City Council", "London Borough of Nation_{}"))), (F.col("doc_id") % 4 + 1).cast("int")))
    buyer = F.when(k.isin(3, 4), "Twin Body").when(k == 7, "Old Seven & Co").otherwise(F.replace(name, F.lit("{}"), k.cast("string")))
    code = lambda n: F.max(F.when(F.col("nk") == n, F.col("lad_code")))
    aliases = i.config.agg(code(3).alias("a"), code(4).alias("b"), code(8).alias("c")).select(F.inline(F.array(F.struct(F.lit("Twin Body").alias("alias"), F.col("a").alias("lad_code")), F.struct(F.lit("TWIN body council").alias("alias"), F.col("b").alias("lad_code")), F.struct(F.lit("old seven and co").alias("alias"), F.col("c").alias("lad_code")))))
    return notices.area_profile(notices.resolve_areas(i.notices.withColumn("buyer_name", buyer), i.config, aliases))


@query(duck("entries", f"""
SELECT supplier_canon, round(n / (1 + span / 30.4) / ln(2.718281828 + councils) * ln(1 + greatest(0.0, value)), 6) AS score
FROM (SELECT supplier_canon, CAST(count(*) AS DOUBLE) AS n, CAST(max(end_date) - min(end_date) AS DOUBLE) AS span, count(DISTINCT council) AS councils, CAST(sum(value_amount) AS DOUBLE) AS value FROM entries WHERE end_date >= DATE '{AS_OF}' GROUP BY 1 HAVING sum(value_amount) IS NOT NULL) e"""))
def w10_scores(i: Inputs):
    e = i.entries.where(F.col("end_date") >= F.lit(AS_OF).cast("date")).groupBy("supplier_canon")
    e = e.agg(F.count("*").cast("double").alias("n"), F.datediff(F.max("end_date"), F.min("end_date")).alias("span"), F.count_distinct("council").alias("councils"), F.sum("value_amount").cast("double").alias("value")).where("value IS NOT NULL")
    return e.select("supplier_canon", F.round(K.score(F.col("n"), F.col("span"), F.col("councils"), F.col("value")), 6).alias("score"))


# --- sources and sinks ----------------------------------------------------------------------


@query("""SELECT o_orderkey % 3 AS source_id, '1995-0' || CAST(o_orderkey % 3 + 1 AS VARCHAR) AS period, 'Payee, ' || CAST(o_custkey AS VARCHAR) AS supplier, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS service, CAST(o_orderkey AS VARCHAR) AS category FROM orders""")
def s01_files_by_position(i: Inputs):
    """Three folders of files, each with its own column positions; the catalogue has a row a file."""
    at, k = scratch(i.spark, "payments"), F.col("o_orderkey")
    o = i.orders.select((k % 3).alias("s"), F.concat(F.lit("Payee, "), "o_custkey").alias("supplier"), F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("amount"), F.col("o_orderpriority").alias("service"), k.cast("string").alias("key"))
    for s, order in enumerate((["supplier", "amount", "service", "key"], ["amount", "key", "supplier"], ["key", "supplier", "amount"])):
        o.where(F.col("s") == s).select(*order).repartition(2).write.option("header", s == 1).option("quoteAll", True).csv(f"{at}/{s}")
    paths = i.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(at).select(F.col("path").alias("url")).withColumn("source_id", F.regexp_extract("url", r"/(\d)/[^/]*$", 1).cast("long"))
    # Positions by source: supplier, amount, service, category; -1 is absent.
    places = i.spark.createDataFrame([(0, 0, 0, 1, 2, 3), (1, 1, 2, 0, -1, 1), (2, 0, 1, 2, -1, 0)], "source_id long, skip_rows int, col_supplier int, col_amount int, col_service int, col_category int")
    catalogue = paths.join(F.broadcast(places), "source_id").withColumns({"period": F.concat(F.lit("1995-0"), (F.col("source_id") + 1).cast("string")), "col_date": F.lit(-1)})
    return files.read_spend_files(i.spark, catalogue).select("source_id", "period", "supplier", "amount", "service", "category")


@query("SELECT o_orderkey, CAST(r AS INT) AS row_no, CASE r WHEN 0 THEN 'Name|£' ELSE 'A & B ' || CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority END AS cells FROM orders, (VALUES (0), (1)) v(r)")
def s07_html_tables(i: Inputs):
    page = F.concat(F.lit("<p>x</p><TABLE class=a><tr><th>Name</th><th>&pound;</th></tr>\n<tr><td><b>A &amp; B</b>&nbsp; "), "o_custkey", F.lit("</td><td>\n "), "o_orderpriority", F.lit(" </td></tr></TABLE><table><tr><td>second</td></tr></table>"))
    rows = html.table_rows(i.orders.select(F.col("o_orderkey").alias("page_id"), page.alias("html")))
    return rows.select(F.col("page_id").alias("o_orderkey"), "row_no", F.array_join("cells", "|").alias("cells"))


@query(duck("config", "SELECT nullif(lad_code, '') AS lad_code, CAST(CASE WHEN nk % 4 > 0 THEN population END AS INT) AS population, CAST(NULL AS DOUBLE) AS imd FROM config"))
def s10_reference_csv(i: Inputs):
    """Headers with spaces, a number that is none, a column that the file lacks."""
    at = scratch(i.spark, "reference")
    i.config.select(F.col("lad_code").alias(" LAD_Code "), F.when(F.col("nk") % 4 > 0, F.col("population").cast("string")).otherwise("n/a").alias("Population ")).write.option("header", True).csv(at)
    return files.read_reference_csv(i.spark, at, "lad_code string, population int, imd double")


@query(duck("spend", "SELECT council, count(*) AS n FROM spend WHERE council <> 'NATION_1' AND council <> 'NATION_2' GROUP BY 1 UNION ALL SELECT 'NATION_1', count(*) FROM spend WHERE council = 'NATION_1' AND line = 1"))
def s11_scoped_sink(i: Inputs):
    """Written, replaced for one council and emptied for another, and read back."""
    at, rows = scratch(i.spark, "scopes"), i.spend.select("council", "period", "amount", "line")
    store.replace_scopes(i.spark, at, rows, ["council"])
    store.replace_scopes(i.spark, at, rows.where("council = 'NATION_1' AND line = 1"), ["council"], scopes=rows.where("council = 'NATION_2'").select("council"))
    return store.read_table(i.spark, at).groupBy("council").agg(F.count("*").alias("n"))


@query(duck("spend", "SELECT council, period, CAST(sum(amount) AS DOUBLE) AS total FROM spend GROUP BY 1, 2"))
def s12_published(i: Inputs):
    """The second version is what readers see."""
    at, totals = scratch(i.spark, "published"), i.spend.groupBy("council", "period").agg(F.sum("amount").cast("double").alias("total"))
    sinks.publish(totals.where("period < '1994'"), at)
    sinks.publish(totals, at)
    return sinks.published(i.spark, at)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS note FROM orders")
def s13_queue(i: Inputs):
    at = scratch(i.spark, "queue")
    sinks.write_tsv(i.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("note")), at)
    return i.spark.read.option("sep", "\t").option("header", True).csv(at)


# --- incremental jobs -----------------------------------------------------------------------


@query("SELECT CAST(o_orderkey AS VARCHAR) AS category, 'Payee, ' || CAST(o_custkey AS VARCHAR) AS supplier, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS amount, count(*) OVER () AS recorded FROM orders")
def i01_payment_stream(i: Inputs):
    """Two runs over a folder that grows: each file is read once, and its count is committed with its rows."""
    at = scratch(i.spark, "stream")
    o = i.orders.select(F.concat(F.lit("Payee, "), "o_custkey").alias("Supplier Name"), F.col("o_totalprice").cast("decimal(14,2)").alias("Amount"), F.col("o_orderkey").alias("Category"))
    spec = i.spark.createDataFrame([("supplier", "supplier", "prefix"), ("amount", "amount", "exact"), ("category", "category", "exact")], "field string, text string, mode string")
    for half in (0, 1):
        o.where(F.col("Category") % 2 == half).repartition(2).write.mode("append").option("header", True).csv(f"{at}/in")
        incremental.import_payment_files(i.spark, f"{at}/in", f"{at}/store", f"{at}/checkpoint", ["supplier", "amount"], spec, buckets=8).awaitTermination()
    recorded = store.read_table(i.spark, f"{at}/store", "files").agg(F.sum("records").alias("recorded"))
    return store.read_table(i.spark, f"{at}/store").select("category", "supplier", "amount").crossJoin(F.broadcast(recorded))


@query("""SELECT 'n' || CAST(user_id AS VARCHAR) AS ocid, arg_max(event_type, event_id) AS status, CAST(arg_max(event_id, event_id) FILTER (WHERE event_id % 3 = 0) AS DOUBLE) AS value_amount, arg_max(event_type, event_id) = 'click' AS tagged
FROM events GROUP BY user_id""")
def i02_notice_sync(i: Inputs):
    """Two batches of versions, the second with late ones too, into buckets; each is tagged on the way."""
    at = scratch(i.spark, "sync")
    rows = i.events.select(F.concat(F.lit("n"), "user_id").alias("ocid"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("double")).alias("value_amount"))
    for part in (0, 1):
        rows.where(F.col("seq") % 2 == part).coalesce(4).write.mode("append").json(f"{at}/in")
        incremental.sync_notices(i.spark, f"{at}/in", "ocid string, seq long, status string, value_amount double", f"{at}/store", f"{at}/checkpoint", enrich=lambda df: df.withColumn("tagged", F.col("status") == "click"), buckets=8).awaitTermination()
    return store.read_table(i.spark, f"{at}/store").select("ocid", "status", "value_amount", "tagged")
