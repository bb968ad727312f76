"""The driver's tables as the library's inputs.

One SELECT for each input, in SQL that Spark and DuckDB both run; the queries
take them as DataFrames and the oracle SQL as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1999-01-01"
NOTICES_AS_OF = "2025-01-01"
JOINT = "NATION_24"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "config": """
SELECT n_nationkey AS nk, n_name AS council,
  CASE WHEN n_nationkey = 24 THEN '' ELSE substr('ESWN', n_nationkey % 4 + 1, 1) || lpad(CAST(n_nationkey AS STRING), 8, '0') END AS lad_code,
  CASE WHEN n_nationkey = 24 THEN 'Joint Committee' WHEN n_nationkey % 5 = 0 THEN 'Strategic Authority' WHEN n_nationkey % 5 = 1 THEN 'County Council'
       WHEN n_nationkey % 5 = 2 THEN 'District Council' WHEN n_nationkey % 5 = 3 THEN 'Unitary Authority' ELSE 'London Borough' END AS council_type,
  CASE n_nationkey % 4 WHEN 1 THEN 'Scotland' WHEN 2 THEN 'Wales' WHEN 3 THEN 'Northern Ireland' ELSE r_name END AS region,
  CASE WHEN n_nationkey % 3 = 0 THEN 'No current strategic authority' ELSE 'Authority ' || CAST(n_regionkey AS STRING) END AS combined_authority,
  50000 + 10000 * n_nationkey AS population
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "spend": """
SELECT council, lad_code, s_name AS supplier_canon,
  CASE l_linenumber % 3 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) || ' LTD' ELSE '  ' || s_name || ' Limited' END AS supplier_raw,
  p_type AS service, p_brand AS category,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN -CAST(l_extendedprice AS DECIMAL(14,2)) ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END AS amount,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS paid_date,
  substr(CAST(o_orderdate AS STRING), 1, 7) AS period,
  CASE WHEN l_suppkey % 20 = 0 THEN 1 ELSE 0 END AS internal_provider,
  CASE l_partkey % 10 WHEN 0 THEN 'invalid' WHEN 1 THEN 'valid' WHEN 2 THEN 'uncertain' END AS validation_status,
  l_linenumber AS line, CAST(nk AS BIGINT) AS nk, l_orderkey AS okey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN config ON c_nationkey = nk
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "ca_spend": """
SELECT 'Authority ' || CAST(nk % 5 AS STRING) AS ca_name, supplier_raw, supplier_canon, service, amount, paid_date, period
FROM spend WHERE line = 1 AND nk % 5 = 0 AND nk <> 24""",
    "entries": """
SELECT o_orderkey AS id, council, lad_code, s_name AS supplier_canon,
  p_name || ' ' || p_type || ' ' || o_orderpriority AS contract_title,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS value_amount,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), CAST(30 + o_orderkey % 900 AS INT)) END AS end_date,
  CASE WHEN o_custkey % 3 <> 0 THEN 1 ELSE 0 END AS is_tech
FROM orders JOIN customer ON o_custkey = c_custkey JOIN config ON c_nationkey = nk
  JOIN (SELECT l_orderkey AS fk, l_suppkey AS fs, l_partkey AS fp FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem) m WHERE rn = 1) x ON fk = o_orderkey
  JOIN supplier ON s_suppkey = fs JOIN part ON p_partkey = fp""",
    "notices": """
SELECT 'ocds-' || CAST(doc_id AS STRING) AS ocid, doc_id, substr(text, 1, 80) AS title, substr(text, 81) AS description, 'Council ' || source AS buyer_name,
  CASE doc_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'planned' WHEN 2 THEN 'complete' ELSE 'cancelled' END AS status,
  CASE doc_id % 8 WHEN 0 THEN '30' WHEN 1 THEN '32' WHEN 2 THEN '48' WHEN 3 THEN '64' WHEN 4 THEN '72' WHEN 5 THEN '73' WHEN 6 THEN '45' ELSE '90' END AS cpv_division,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id * 37.5 AS DECIMAL(15,2)) END AS value_amount,
  date_add(DATE '2024-01-01', CAST(doc_id % 700 AS INT)) AS published_date,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE date_add(DATE '2024-01-01', CAST(doc_id % 700 + 30 AS INT)) END AS tender_end_date,
  CASE doc_id % 5 WHEN 0 THEN 'Supplier ' || CAST(doc_id % 23 AS STRING) WHEN 1 THEN 'Supplier ' || CAST(doc_id % 23 AS STRING) || ' | supplier ' || CAST(doc_id % 7 AS STRING)
    WHEN 2 THEN 'Not awarded' WHEN 3 THEN 'Supplier 1 | Supplier ' || CAST(doc_id % 23 AS STRING) || ' | Not awarded' ELSE NULL END AS supplier_names
FROM documents""",
    "geo": "SELECT lad_code, 50 + 0.2 * (nk % 5) AS lat, -3 + 0.2 * floor(nk / 5) AS lon FROM config WHERE lad_code <> ''",
    "la_reference": "SELECT lad_code, CASE WHEN nk % 6 = 0 THEN NULL ELSE CAST(10 + (nk * 7) % 30 AS DOUBLE) END AS imd_avg_score FROM config WHERE lad_code <> ''",
    "lineage": "SELECT council AS pred_name, lad_code AS pred_lad_code, region, 'LGR' || lpad(CAST(CAST(floor(nk / 5) AS INT) AS STRING), 6, '0') AS succ_key FROM config",
    "sources": """
SELECT row_number() OVER (ORDER BY council, period) AS id, council, period, CASE WHEN period = '1991-01' THEN 0 WHEN period = '1991-02' THEN NULL ELSE 1 END AS last_count, 1 AS active
FROM (SELECT DISTINCT council, period FROM spend UNION ALL SELECT council, '1991-01' FROM config UNION ALL SELECT council, '1991-02' FROM config) s""",
}
NEEDS = {
    "config": ["nation", "region"], "spend": ["lineitem", "orders", "customer", "config", "supplier", "part"], "ca_spend": ["spend"],
    "entries": ["orders", "customer", "config", "lineitem", "supplier", "part"], "notices": ["documents"], "geo": ["config"], "la_reference": ["config"],
    "lineage": ["config"], "sources": ["spend", "config"],
}


class Inputs:
    """Lazily built inputs of one folder: ``Inputs(spark, sf_dir).spend``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = SQL[name]
                parts = {n: getattr(self, n) for n in NEEDS[name]}
                self._known[name] = self.spark.sql(_bound(sql, parts), **parts)
        return self._known[name]


def _bound(sql: str, parts) -> str:
    """Table names after FROM and JOIN as references to DataFrames."""
    import re

    return re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in parts else m[0], sql)


def duck(names: str, body: str) -> str:
    """Oracle SQL: ``body`` with the named inputs as common table expressions."""
    want: list[str] = []

    def add(n: str) -> None:
        if n in SQL and n not in want:
            for k in NEEDS[n]:
                add(k)
            want.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n].replace('date_add(', 'date_plus(')})" for n in want)
    ctes = _dates(ctes)
    return f"WITH {ctes}\n{body.strip()}" if not body.strip().upper().startswith("WITH ") else f"WITH {ctes},\n{body.strip()[5:]}"


def _dates(sql: str) -> str:
    """Spark's date_add(d, n) in the other dialect: d + n."""
    import re

    return re.sub(r"date_plus\((CAST\(o_orderdate AS DATE\)|DATE '2024-01-01'), (CAST\([^)]*\))\)", r"(\1 + \2)", sql)
