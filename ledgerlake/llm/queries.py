"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import alignment, bpe, conversations, decontam, hnsw, line_dedup, media, mixing, pii, simhash, token_counts, toxicity, url_filter
from ledgerlake.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"))


#: Host and path rules of op2's contract, and the globs that judge what none of them fits.
URL_RULES = (
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
    url_filter.Rule("**spam-farm**", "block", glob=True),
    url_filter.Rule("**cheap-pills**", "block", glob=True),
    url_filter.Rule("**casino*/**", "block", glob=True),
    url_filter.Rule("**/wp-login*", "block", glob=True),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def pii_key(spark: SparkSession) -> str:
    """The session's ``ledgerlake.pii.key``; without one a key is drawn for this session, so that nobody can undo the pseudonyms."""
    key = spark.conf.get("ledgerlake.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("ledgerlake.pii.key", key)
    return key


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.near_copies(media.pictures_of(table(spark, sf_dir, "embeddings")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(conversations.damaged(table(spark, sf_dir, "conversations")), keep="keep")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_url_filter": op2_url_filter,
        "op3_line_dedup": op3_line_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_pii": op5_pii,
        "op6_mixing": op6_mixing,
        "op7_media": op7_media,
        "op8_simhash": op8_simhash,
        "op9_token_counts": op9_token_counts,
        "op10_bpe": op10_bpe,
        "op11_decontamination": op11_decontamination,
        "op12_conversations": op12_conversations,
        "op13_alignment": op13_alignment,
    }


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(host || path, 'spam-farm') OR contains(host || path, 'cheap-pills') OR regexp_matches(host || path, 'casino[^/]*/') OR regexp_matches(path, '/wp-login[^/]*$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents
), l AS (
  SELECT rid, doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE shared.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE shared.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN shared USING (key) GROUP BY rid, doc_id
"""


#: Seat by seat: every quotient is listed and ranked.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR))) AS draw FROM documents
), s AS (
  SELECT *, (CAST('0x' || substr(draw, 25, 8) AS BIGINT) + size) % (SELECT greatest(1, CAST(ceil(count(*) / 20000) AS BIGINT)) FROM documents) AS shard FROM d
), cells AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS words FROM s GROUP BY 1, 2
), totals AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS total, CAST(sum(words) AS BIGINT) * 3 AS cap FROM cells GROUP BY 1
), weighed AS (
  SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM totals
), filled AS (
  SELECT *, coalesce(sum(cap) OVER f, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS open, sum(total) OVER () AS everything
  FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, CAST(everything - capped AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM filled
), targets AS (
  SELECT source, total, coalesce(least(w * (SELECT arg_min(level, cap / w) FROM levels WHERE level * w <= cap), CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM levels
), seats AS (
  SELECT source, target, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS place, (SELECT CAST(round(sum(target) / 32) AS BIGINT) FROM targets) AS blocks
  FROM (SELECT *, unnest(generate_series(1, CAST(target / 16 AS BIGINT) + 4)) AS k FROM targets) q
), quotas AS (
  SELECT t.source, t.total, t.target, (SELECT count(*) FROM seats q WHERE place <= blocks AND q.source IS NOT DISTINCT FROM t.source AND q.target > 0) AS quota FROM targets t
), ranked AS (
  SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY CAST(words AS DOUBLE) / (2 * k - 1) DESC, shard, k) AS place, words
  FROM (SELECT c.*, q.quota, unnest(generate_series(1, CAST(quota AS BIGINT) + 1)) AS k FROM cells c JOIN quotas q ON c.source IS NOT DISTINCT FROM q.source) x
), shares AS (
  SELECT c.source, c.shard, c.words, any_value(q.total) AS source_size, any_value(q.target) AS target, least(count(*) FILTER (WHERE r.place <= r.quota AND c.words > 0) * 32, 3 * c.words) AS take
  FROM cells c JOIN quotas q ON c.source IS NOT DISTINCT FROM q.source JOIN ranked r ON r.source IS NOT DISTINCT FROM c.source AND r.shard = c.shard GROUP BY 1, 2, 3
), runs AS (
  SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes, CASE WHEN words > 0 THEN take % words ELSE 0 END AS rest,
    CASE WHEN words > 0 THEN CAST('0x' || substr(md5(concat_ws('|', 'mix-1', source, CAST(shard AS VARCHAR))), 1, 8) AS BIGINT) % CAST(ceil(words / 32) AS BIGINT) * 32 ELSE 0 END AS start FROM shares
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, size ROWS UNBOUNDED PRECEDING) AS stop FROM s
)
SELECT doc_id, size, source_size, target, CAST(passes * size
  + greatest(least(stop, least(start + rest, words)) - greatest(stop - size, start), 0)
  + greatest(least(stop, start + rest - words) - greatest(stop - size, 0), 0) AS BIGINT) AS taken
FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND p.shard = r.shard
"""


#: Windows as lists of up to ten words from each word on.
OP11_SQL = r"""
WITH i AS (
  SELECT row_number() OVER () AS rid, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), iw AS (
  SELECT rid, item, least(len(words), 10) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM i
), windows AS (
  SELECT DISTINCT item, size, array_to_string(ten, ' ') AS said
  FROM (SELECT item, size, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM iw) x WHERE len(ten) = size
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), dw AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), here AS (
  SELECT rid, pos, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM dw
), found AS (
  SELECT h.rid, h.pos, h.size, w.item FROM (SELECT rid, pos, size, array_to_string(ten[1:size], ' ') AS said FROM here, (SELECT DISTINCT size FROM windows) s WHERE len(ten) >= size) h
  JOIN windows w ON h.size = w.size AND h.said = w.said
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(pos, pos + size - 1)) AS p FROM (SELECT DISTINCT rid, pos, size FROM found) x) y GROUP BY 1
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM found) x GROUP BY 1
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op11_decontamination": OP11_SQL}
