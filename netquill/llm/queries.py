"""The queries of the operators, by their contracts, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.llm import kneser_ney, lpt, mixing, outliers, secrets, simhash, suffix_dedup, token_scan, url_alias, winnow
from netquill.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 64-bit fingerprints over three-word shingles that differ in at most 3 bits."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, width=64, tables=1, budget=3, check=None)
    return got.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")[0]).alias("fingerprint"), "component_id")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    perplexity = F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n")))
    return got.select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_scored"), F.round(perplexity, 4).alias("perplexity"), F.round("score", 6).alias("score"), F.col("worst").alias("threshold"), "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS lev FROM w
), t AS (
  SELECT source, source_size, least(cap, w * max(lev) OVER ()) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    (('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lpt.shard_plan(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the 50k byte-level vocabulary in each document."""
    got = token_scan.count_tokens(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_tokens", "stream", "ordinal")


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = outliers.quality_rules(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance"))


def op8_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


#: The fixed rules of the op9 contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_alias.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return got.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


_ADDRESS = r"""CASE WHEN {h} <> '' THEN regexp_replace({h}, '^www\.', '') || regexp_replace({p}, '/+$', '') || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END END"""
_QUERY = r"""array_to_string(list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|ref|gclid|fbclid)(=.*)?$')), '&')"""
_HOST = r"""translate(regexp_extract(regexp_extract({u}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_PATH = r"""regexp_extract(regexp_extract({u}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*([^?#]*)', 1)"""


def _rule_sql(h: str, p: str) -> str:
    """List of the fitting rule and its verdict, longest first."""
    cases = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        own, _, tail = rule.partition("/")
        cases.append(f"WHEN ({h} = '{own}' OR ends_with({h}, '.{own}')) AND starts_with({p}, '/{tail}') THEN ['{rule}', '{verdict}']")
    return "CASE " + " ".join(cases) + " END"


def _parsed(name: str, source: str, keep: str) -> str:
    u = "coalesce(url, '')"
    return f"""{name}0 AS (SELECT {keep}, {_HOST.format(u=u)} AS host, {_PATH.format(u=u)} AS path, {_QUERY.format(u=u)} AS query FROM {source}),
 {name} AS (SELECT *, {_ADDRESS.format(h='host', p='path', q='query')} AS node, {_rule_sql('host', 'path')} AS r FROM {name}0)"""


_LINKS = [
    r"""(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)""", r"""(?i)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b""",
    r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)""", r"""(?i)<meta\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b""",
]
OP9_SQL = rf"""
WITH RECURSIVE {_parsed('p', 'pages', 'page_id, url, html')},
l0 AS (SELECT DISTINCT node AS src, host AS own, path AS base, unnest({' || '.join(f"regexp_extract_all(html, '{x}', 1)" for x in _LINKS)}) AS href FROM p WHERE node IS NOT NULL AND html IS NOT NULL),
l1 AS (SELECT src, own, base, regexp_replace(regexp_replace(href, '(?i)&(amp|#38|#x26);', '&', 'g'), '#.*$', '') AS link FROM l0),
l2 AS (SELECT *, regexp_extract(link, '^([^?]*)', 1) AS cut FROM l1),
l3 AS (SELECT *, substr(link, length(cut) + 1) AS query0, CASE WHEN starts_with(cut, '/') THEN cut ELSE CASE WHEN contains(base, '/') THEN regexp_replace(base, '[^/]*$', '') ELSE '/' END || cut END AS full0 FROM l2),
l4 AS (SELECT *, CASE WHEN contains(full0, '/.') THEN list_reduce(string_split(full0, '/')[2:], lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, '') || CASE WHEN regexp_matches(full0, '/\.\.?$') THEN '/' ELSE '' END ELSE full0 END AS plain FROM l3),
l5 AS (SELECT src, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link = '' OR own = '' OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(link, '//') THEN 'http:' || link WHEN cut = '' THEN 'http://' || own || base || query0 ELSE 'http://' || own || plain || query0 END AS url FROM l4),
{_parsed('t', 'l5', 'src, url')},
e AS (SELECT src AS a, node AS b FROM t WHERE node IS NOT NULL UNION SELECT node, src FROM t WHERE node IS NOT NULL),
bad AS (SELECT DISTINCT node FROM p WHERE r[2] = 'block' AND node IS NOT NULL UNION SELECT node FROM t WHERE r[2] = 'block' AND node IS NOT NULL),
reach AS (SELECT node FROM bad UNION SELECT e.b FROM reach JOIN e ON e.a = reach.node)
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM i, range(1, greatest(len(w) - 9, 1) + 1) t(p) WHERE len(w) > 0
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), lens AS (SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM d, lens, range(1, len(w) - n + 2) t(p)
), hit AS (
  SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)
), pos AS (
  SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM hit, range(0, n) r(o) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op1_simhash": op1_simhash, "op2_kneser_ney": op2_kneser_ney, "op3_mixing": op3_mixing, "op4_separators": op4_separators, "op5_suffix_arrays": op5_suffix_arrays, "op6_outliers": op6_outliers, "op7_sharding": op7_sharding, "op8_markov": op8_markov, "op9_redirects": op9_redirects, "op10_winnowing": op10_winnowing}
ORACLE = {"op3_mixing": OP3_SQL, "op9_redirects": OP9_SQL, "op10_winnowing": OP10_SQL}
