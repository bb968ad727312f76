"""Queries over payments: summaries, filters, coverage, fingerprints; each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import text
from ledgerlake.operators import filters
from ledgerlake.operators import summaries as S
from ledgerlake.plans.fixtures import JOINT, Inputs, duck
from ledgerlake.plans.registry import Registry

R = Registry()
query = R.query

#: Joint bodies and their areas' shares: a parameter of the library.
SHARES = {JOINT: {"E00000000": 0.5, "E00000004": 0.5}}
LIVE = "internal_provider = 0 AND (validation_status IS NULL OR validation_status <> 'invalid')"
NAMED = "supplier_canon IS NOT NULL AND supplier_canon <> ''"
FY_P = "(CAST(substr(period, 1, 4) AS INT) - CASE WHEN CAST(substr(period, 6, 2) AS INT) < 4 THEN 1 ELSE 0 END)"
FY_D = "CAST(year(paid_date) - CASE WHEN month(paid_date) < 4 THEN 1 ELSE 0 END AS INT)"
DEVOLVED = "JOIN config c ON s.lad_code = c.lad_code AND NOT (c.council_type = 'Strategic Authority' AND c.region IN ('Scotland', 'Wales', 'Northern Ireland'))"
SUM = "CAST(sum(amount) AS DOUBLE)"


@query(duck("spend entries", f"""
SELECT p.*, coalesce(contract_count, 0) AS contract_count, coalesce(contract_value, 0) AS contract_value FROM (
  SELECT supplier_canon, count(DISTINCT council) AS council_count, count(*) AS payment_count, {SUM} AS total_spend FROM spend WHERE {LIVE} AND {NAMED} GROUP BY 1) p
LEFT JOIN (SELECT supplier_canon, count(*) AS contract_count, CAST(sum(value_amount) AS DOUBLE) AS contract_value FROM entries WHERE is_tech = 1 GROUP BY 1) e USING (supplier_canon)"""))
def a01_supplier_summary(i: Inputs):
    return S.supplier_summary(i.spend, i.entries)


@query(duck("spend", f"SELECT supplier_canon, {FY_D} AS fy, count(DISTINCT council) AS council_count, count(*) AS payment_count, {SUM} AS total_spend FROM spend WHERE {LIVE} AND {NAMED} AND paid_date IS NOT NULL GROUP BY 1, 2"))
def a02_supplier_fy(i: Inputs):
    return S.supplier_fy(i.spend)


def _joint_sql(fy: bool, suppliers: bool) -> str:
    k, g = (f"{FY_P} AS fy, ", "GROUP BY ALL") if fy else ("", "GROUP BY ALL")
    n = ", count(DISTINCT supplier_canon) AS suppliers" if suppliers else ""
    out = ", CAST(sum(suppliers) AS BIGINT) AS supplier_count" if suppliers else ""
    return f"""
SELECT lad_code, {'fy, ' if fy else ''}CAST(sum(t) AS DOUBLE) AS total_spend, CAST(sum(n) AS BIGINT) AS payment_count{out} FROM (
  SELECT lad_code, {k}CAST(sum(amount) AS DECIMAL(18,2)) AS t, count(*) AS n{n} FROM spend WHERE {LIVE} AND lad_code <> '' {g}
  UNION ALL
  SELECT a.lad, {'fy, ' if fy else ''}t * 0.5, round(n * 0.5){', suppliers' if suppliers else ''} FROM (SELECT {k}CAST(sum(amount) AS DECIMAL(18,2)) AS t, count(*) AS n{n} FROM spend WHERE {LIVE} AND council = '{JOINT}' {g} HAVING count(*) > 0) j,
    (VALUES ('E00000000'), ('E00000004')) a(lad)) u
GROUP BY ALL"""


@query(duck("spend", _joint_sql(True, True)))
def a03_council_fy(i: Inputs):
    return S.council_fy(i.spend, SHARES)


@query(duck("spend", f"""
WITH r AS (SELECT s.*, {FY_P} AS fy, substr(s.lad_code, 1, 1) AS pre FROM spend s {DEVOLVED} WHERE {LIVE} AND {NAMED})
SELECT supplier_canon, fy, nation, coalesce(max(councils), 1) AS council_count, CAST(sum(payments) AS BIGINT) AS payment_count, sum(total) AS total_spend FROM (
  SELECT supplier_canon, fy, pre AS nation, count(DISTINCT council) AS councils, count(*) AS payments, {SUM} AS total FROM r WHERE pre <> '' GROUP BY 1, 2, 3
  UNION ALL SELECT supplier_canon, {FY_P}, 'E', NULL, 2 * round(count(*) * 0.5), CAST(2 * CAST(sum(amount) AS DECIMAL(18,2)) * 0.5 AS DOUBLE) FROM spend WHERE {LIVE} AND {NAMED} AND council = '{JOINT}' GROUP BY 1, 2) u GROUP BY 1, 2, 3
UNION ALL SELECT supplier_canon, fy, '', count(DISTINCT council), count(*), {SUM} FROM r GROUP BY 1, 2"""))
def a04_supplier_nation_fy(i: Inputs):
    return S.supplier_nation_fy(i.spend, i.config, SHARES)


@query(duck("spend", _joint_sql(False, False)))
def a05_council_summary(i: Inputs):
    return S.council_summary(i.spend, SHARES)


@query(duck("spend", f"""
SELECT lad_code, CAST(sum(payments) AS BIGINT) AS payments, round(sum(total), 4) AS total FROM (
  SELECT a.lad AS lad_code, count(*) AS payments, CAST(sum(amount) AS DOUBLE) * 0.5 AS total FROM spend, (VALUES ('E00000000'), ('E00000004')) a(lad) WHERE council = '{JOINT}' GROUP BY 1
  UNION ALL SELECT lad_code, count(*), CAST(sum(amount) AS DOUBLE) FROM spend WHERE council <> '{JOINT}' GROUP BY 1) u GROUP BY 1"""))
def a07_display_view(i: Inputs):
    rows = S.display_rows(i.spend, SHARES, i.config)
    return rows.groupBy("lad_code").agg(F.count("*").alias("payments"), F.round(F.sum("amount").cast("double"), 4).alias("total"))


@query(duck("spend", f"""
WITH g AS (SELECT council, CAST(sum(amount) AS DECIMAL(18,2)) AS total, count(*) AS payments, max(amount) AS largest, min(paid_date) AS first_date, max(paid_date) AS last_date, count(DISTINCT supplier_canon) AS suppliers FROM spend WHERE {LIVE} GROUP BY 1)
SELECT council, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(payments) AS BIGINT) AS payments, CAST(max(largest) AS DOUBLE) AS largest, min(first_date) AS first_date, max(last_date) AS last_date, CAST(sum(suppliers) AS BIGINT) AS suppliers,
  round(CAST(sum(total) AS DOUBLE) / sum(payments), 2) AS average FROM (
  SELECT * FROM g WHERE council <> '{JOINT}'
  UNION ALL SELECT a.c, total * 0.5, round(payments * 0.5), largest * 0.5, first_date, last_date, 0 FROM g, (VALUES ('NATION_0'), ('NATION_4')) a(c) WHERE council = '{JOINT}') u GROUP BY 1"""))
def a08_folded_overview(i: Inputs):
    return S.folded_overview(i.spend, SHARES, i.config)


@query(duck("spend", f"""
SELECT council, {SUM} AS total, count(*) AS payments, count(DISTINCT supplier_canon) AS suppliers, round({SUM} / count(*), 2) AS average, CAST(max(amount) AS DOUBLE) AS largest, min(paid_date) AS first_date, max(paid_date) AS last_date,
  any_value(council_type) AS council_type, any_value(region) AS region, round({SUM} / any_value(population), 4) AS per_head FROM spend JOIN (SELECT council, council_type, region, population FROM config) c USING (council) WHERE {LIVE} GROUP BY 1"""))
def a09_overview(i: Inputs):
    return S.overview(i.spend, i.config)


@query(duck("spend", f"SELECT count(*) AS payments, count(DISTINCT supplier_canon) AS suppliers, count(DISTINCT council) AS councils, {SUM} AS total FROM spend WHERE {LIVE}"))
def a10_kpis(i: Inputs):
    return S.kpis(i.spend)


@query(duck("spend", f"SELECT supplier_canon, {SUM} AS total, count(*) AS payments, count(DISTINCT council) AS councils, max(paid_date) AS last_payment FROM spend WHERE {LIVE} AND {NAMED} GROUP BY 1 ORDER BY total DESC, supplier_canon LIMIT 40"))
def a11_top_suppliers(i: Inputs):
    return S.top_suppliers(i.spend)


@query(duck("spend", f"SELECT supplier_canon, string_agg(combined_authority, ', ' ORDER BY combined_authority) AS authorities FROM (SELECT DISTINCT supplier_canon, combined_authority FROM spend JOIN (SELECT council, combined_authority FROM config) c USING (council) WHERE {LIVE} AND {NAMED}) d GROUP BY 1"))
def a11_supplier_authorities(i: Inputs):
    return S.supplier_authorities(i.spend, i.config)


@query(duck("spend ca_spend", f"SELECT council AS organisation, {SUM} AS total, count(*) AS payments, CAST(0 AS INT) AS is_ca FROM spend WHERE {LIVE} GROUP BY 1 UNION ALL SELECT ca_name, {SUM}, count(*), 1 FROM ca_spend GROUP BY 1"))
def a12_totals_by_organisation(i: Inputs):
    return S.totals_by_organisation(i.spend, i.ca_spend)


@query(duck("spend ca_spend", f"""
SELECT m.*, coalesce(own_total, 0) AS own_total FROM (SELECT combined_authority, count(*) AS councils, CAST(sum(t) AS DOUBLE) AS member_total FROM (SELECT council, sum(amount) AS t FROM spend WHERE {LIVE} GROUP BY 1) s JOIN config USING (council) GROUP BY 1) m
LEFT JOIN (SELECT ca_name, {SUM} AS own_total FROM ca_spend GROUP BY 1) o ON ca_name = combined_authority"""))
def a13_authority_groups(i: Inputs):
    return S.authority_groups(i.spend, i.ca_spend, i.config)


@query(duck("spend", f"""
WITH s AS ({_joint_sql(False, False)})
SELECT substr(lad_code, 1, 1) AS nation, region, combined_authority, count(*) AS councils, round(coalesce(sum(total_spend), 0), 3) AS total, CAST(coalesce(sum(payment_count), 0) AS BIGINT) AS payments FROM config LEFT JOIN s USING (lad_code) WHERE lad_code <> '' GROUP BY 1, 2, 3"""))
def a14_nation_page(i: Inputs):
    return S.nation_page(i.config, S.council_summary(i.spend, SHARES))


@query(duck("spend", f"""
WITH m AS (SELECT strftime(unnest(generate_series(DATE '1991-12-01', DATE '1999-01-01', INTERVAL 1 MONTH)), '%Y-%m') AS period)
SELECT period, coalesce({SUM}, 0) AS total, count(amount) AS payments FROM m LEFT JOIN (SELECT * FROM spend WHERE {LIVE}) s USING (period) GROUP BY 1"""))
def a15_monthly_trend(i: Inputs):
    return S.monthly_trend(i.spend, "1991-12", "1999-01")


@query(duck("spend", f"""
WITH m AS (SELECT strftime(unnest(generate_series(DATE '1995-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS period), k AS (SELECT DISTINCT council FROM spend WHERE {LIVE})
SELECT council, period, coalesce({SUM}, 0) AS total, count(amount) AS payments FROM (SELECT * FROM k, m) s LEFT JOIN (SELECT * FROM spend WHERE {LIVE}) x USING (council, period) GROUP BY 1, 2"""))
def a15_council_trend(i: Inputs):
    return S.monthly_trend(i.spend, "1995-01", "1996-12", ["council"])


@query(duck("spend", f"SELECT lad_code, count(*) AS payments, count(DISTINCT supplier_canon) AS suppliers, {SUM} AS total, min(paid_date) AS first_date, max(paid_date) AS last_date, count(DISTINCT period) AS periods FROM spend WHERE {LIVE} GROUP BY 1"))
def a16_payment_profile(i: Inputs):
    return S.payment_profile(i.spend)


@query(duck("spend", f"SELECT supplier_canon, s.council, {SUM} AS total, count(*) AS payments, any_value(c.council_type) AS council_type, any_value(c.region) AS region FROM spend s {DEVOLVED} WHERE {LIVE} AND {NAMED} GROUP BY 1, 2"))
def a17_supplier_by_council(i: Inputs):
    return S.supplier_by_council(i.spend, i.config)


@query(duck("spend sources", f"""
WITH h AS (SELECT council, period FROM spend WHERE {LIVE} UNION SELECT council, period FROM sources WHERE active = 1 AND last_count = 0)
SELECT (SELECT count(*) FROM h WHERE period BETWEEN '1990-12' AND '1998-12') AS held, (SELECT count(*) FROM config) * 97 AS possible, round(100 * (SELECT count(*) FROM h WHERE period BETWEEN '1990-12' AND '1998-12') / ((SELECT count(*) FROM config) * 97), 1) AS percent"""))
def a18_coverage(i: Inputs):
    return S.coverage(i.spend, i.sources, i.config, "1990-12", "1998-12")


@query(duck("spend sources", """
WITH r AS (SELECT council, period, max(CASE WHEN last_count = 0 THEN 1 ELSE 0 END) AS e FROM sources WHERE period <= '1997-06' GROUP BY 1, 2), h AS (SELECT DISTINCT council, period, 1 AS h FROM spend),
b AS (SELECT council, period, greatest(coalesce(h, 0), e) AS ok FROM r LEFT JOIN h USING (council, period))
SELECT council, count(*) AS registered, CAST(sum(ok) AS BIGINT) AS have, coalesce(string_agg(period, ',' ORDER BY period) FILTER (WHERE ok = 0), '') AS missing, min(ok) = 1 AS complete FROM b GROUP BY 1"""))
def a19_completeness(i: Inputs):
    return S.completeness(i.spend, i.sources, "1997-06")


@query(duck("spend", f"SELECT council, min(paid_date) AS first_date, max(paid_date) AS last_date, {SUM} AS total FROM spend WHERE internal_provider = 0 GROUP BY 1"))
def a20_date_span(i: Inputs):
    return S.date_span(i.spend)


@query(duck("spend", "SELECT council, coalesce(validation_status, 'none') AS status, count(*) AS n FROM spend GROUP BY 1, 2"))
def a21_validation_counts(i: Inputs):
    return S.validation_counts(i.spend)


@query(duck("spend la_reference", f"""
WITH h AS (SELECT lad_code, CAST(sum(amount) AS DOUBLE) AS t FROM spend WHERE {LIVE} GROUP BY 1 HAVING sum(amount) > 0), p AS (SELECT t / population AS y, imd_avg_score AS x FROM h JOIN config USING (lad_code) JOIN la_reference USING (lad_code) WHERE imd_avg_score IS NOT NULL AND substr(lad_code, 1, 1) = 'E')
SELECT count(*) AS areas, round(corr(x, y), 6) AS r, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(avg(y), 5) AS mean, round(min(y), 5) AS low, round(max(y), 5) AS high FROM p"""))
def a37_deprivation(i: Inputs):
    return S.deprivation(i.spend, i.config, i.la_reference, nation="E")


#: No oracle: the other engine has no CRC32.  Tests hold it against zlib.
@query(None)
def a39_fingerprints(i: Inputs):
    return S.fingerprints(i.spend, ["supplier_raw", "amount", "paid_date", "service", "category"])


@query(duck("spend", """
WITH o AS (SELECT council, period, count(*) AS n FROM spend WHERE period < '1997-01' GROUP BY 1, 2), c AS (SELECT council, period, count(*) AS n FROM spend WHERE period >= '1993-01' AND NOT (council = 'NATION_3' AND category = 'Brand#11') GROUP BY 1, 2)
SELECT coalesce(o.council, c.council) AS council, coalesce(o.period, c.period) AS period, CASE WHEN c.n IS NULL THEN 'missing' WHEN o.n IS NULL THEN 'extra' WHEN o.n = c.n THEN 'matched' ELSE 'changed' END AS verdict FROM o FULL JOIN c ON o.council = c.council AND o.period = c.period"""))
def a40_fingerprint_diff(i: Inputs):
    cols = ["supplier_raw", "amount", "paid_date", "service", "category"]
    old = S.fingerprints(i.spend.where("period < '1997-01'"), cols)
    new = S.fingerprints(i.spend.where("period >= '1993-01' AND NOT (council = 'NATION_3' AND category = 'Brand#11')"), cols)
    return S.fingerprint_diff(old, new)


@query(duck("spend", f"""
WITH f AS (SELECT supplier_canon, CAST(sum(payments) AS BIGINT) AS payments, sum(total) AS total FROM (
  SELECT supplier_canon, count(*) AS payments, {SUM} AS total FROM spend s {DEVOLVED} WHERE {LIVE} AND {NAMED} AND {FY_P} = 1995 AND substr(s.lad_code, 1, 1) = 'E' GROUP BY 1
  UNION ALL SELECT supplier_canon, 2 * round(count(*) * 0.5), CAST(2 * CAST(sum(amount) AS DECIMAL(18,2)) * 0.5 AS DOUBLE) FROM spend WHERE {LIVE} AND {NAMED} AND {FY_P} = 1995 AND council = '{JOINT}' GROUP BY 1) u GROUP BY 1)
SELECT s_name AS supplier_canon, coalesce(payments, 0) AS payments, coalesce(total, 0) AS total FROM (SELECT DISTINCT s_name FROM supplier) n LEFT JOIN f ON s_name = supplier_canon"""))
def a42_supplier_directory(i: Inputs):
    figures = S.supplier_nation_fy(i.spend, i.config, SHARES).where("fy = 1995 AND nation = 'E'").select("supplier_canon", F.col("payment_count").alias("payments"), F.col("total_spend").alias("total"))
    return S.supplier_directory(i.supplier.select(F.col("s_name").alias("supplier_canon")).distinct(), figures)


@query(duck("spend", f"SELECT c.council, coalesce(payments, 0) AS payments, coalesce(total, 0) AS total FROM config c LEFT JOIN (SELECT council, count(*) AS payments, {SUM} AS total FROM spend WHERE {LIVE} AND {FY_P} = 1995 GROUP BY 1) s ON c.council = s.council"))
def a43_council_directory(i: Inputs):
    figures = i.spend.where(filters.live() & filters.in_fy(1995, "period")).groupBy("council").agg(F.count("*").alias("payments"), S.money(F.sum("amount")).alias("total"))
    return i.config.select("council").join(figures, "council", "left").na.fill(0, ["payments"]).na.fill(0.0, ["total"])


@query(duck("spend", f"""
WITH t AS (SELECT service, {SUM} AS total FROM spend WHERE {LIVE} GROUP BY 1)
SELECT service, total, round(100 * total / sum(total) OVER (), 4) AS share, round(100 * total / max(total) OVER (), 4) AS bar FROM t"""))
def w07_share_of_total(i: Inputs):
    return S.with_share(i.spend.where(filters.live()).groupBy("service").agg(S.money(F.sum("amount")).alias("total")), "total")


@query(duck("spend", f"SELECT council, count(*) AS n, {SUM} AS total FROM spend WHERE {LIVE} AND paid_date BETWEEN DATE '1995-04-01' AND DATE '1996-03-31' GROUP BY 1"))
def f02_fy_window(i: Inputs):
    return i.spend.where(filters.live() & filters.in_fy(1995)).groupBy("council").agg(F.count("*").alias("n"), S.money(F.sum("amount")).alias("total"))


@query(duck("spend", f"SELECT council, count(*) AS n FROM spend SEMI JOIN (SELECT council FROM config WHERE council_type IN ('County Council', 'London Borough') AND substr(lad_code, 1, 1) = 'E') c USING (council) GROUP BY 1"))
def f03_organisations(i: Inputs):
    who = filters.organisations(i.config, types=["County Council", "London Borough"], nation="E")
    return i.spend.join(who.select("council"), "council", "left_semi").groupBy("council").agg(F.count("*").alias("n"))


@query(duck("spend", "SELECT category, count(*) AS n FROM spend WHERE lower(category) LIKE '%brand#1%' OR lower(category) = 'x' GROUP BY 1"))
def f05_category_gate(i: Inputs):
    return i.spend.where(filters.category_gate(F.lit("Brand#1, X"), F.col("category"))).groupBy("category").agg(F.count("*").alias("n"))


@query(duck("spend", "SELECT council, count(*) AS n FROM spend WHERE paid_date IS NULL OR paid_date >= CASE WHEN nk % 2 = 0 THEN DATE '1995-04-01' ELSE DATE '1995-01-01' END GROUP BY 1"))
def f08_era_floor(i: Inputs):
    return i.spend.where(filters.era("1995-01-01", "1995-04-01", F.col("nk") % 2 == 0)).groupBy("council").agg(F.count("*").alias("n"))


@query(duck("spend", f"SELECT CAST(CAST(substr(period, 1, 4) AS INT) - CASE WHEN CAST(substr(period, 6, 2) AS INT) < 4 THEN 1 ELSE 0 END AS INT) AS fy, {SUM} AS total FROM spend WHERE {LIVE} GROUP BY 1"))
def a42_totals_by_year(i: Inputs):
    """The totals that a directory's rows are measured by."""
    return S.overall_fy(i.spend)


@query(duck("spend", f"SELECT council, supplier_canon, {SUM} AS total FROM spend WHERE {LIVE} GROUP BY 1, 2 ORDER BY total DESC, council, supplier_canon LIMIT 25 OFFSET 50"))
def l01_page(i: Inputs):
    agg = i.spend.where(filters.live()).groupBy("council", "supplier_canon").agg(S.money(F.sum("amount")).alias("total"))
    return agg.orderBy(F.desc("total"), "council", "supplier_canon").offset(50).limit(25)
