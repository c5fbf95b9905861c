"""The queries of this subpackage: one for each operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .embedding_dedup import near_duplicate_vectors
from .line_dedup import drop_recurring_lines
from .packing import pack
from .quality_crf import score_quality
from .simhash import near_duplicates
from .substring_dedup import remove_repeated_windows
from .token_counts import count_tokens
from .tokens import tokenizer_path
from .toxicity import score_toxicity
from .url_filters import filter_urls, site_rule, word_rule

#: The contract's rules, longest first by nature, then words by which the method itself blocks.
SITE_RULES = [site_rule("allow", "org/"), site_rule("block", "example.org/es/"), site_rule("block", "example.org/en/1"), site_rule("allow", "com/fr/"), site_rule("block", "com/de/")]
BLOCKED_WORDS = ("spam", "casino", "porn", "xxx", "malware", "phishing")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's kept text as a digest beside its counts."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7, modulus=3, rest=1)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, modulus=5, rest=0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), window=35)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and extends the cache that the session names in ``meridian.token.cache``; unset, a cache of this run."""
    cache = spark.conf.get("meridian.token.cache", None)
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), cache, limit=512)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*SITE_RULES, *(word_rule("block", w) for w in BLOCKED_WORDS)]
    return filter_urls(table(spark, sf_dir, "pages"), rules).drop("n_candidates")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), capacity=2048)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_each=4, max_bits=4)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_url_filters": op7_url_filters,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLE = {
    "op4_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), p AS (
  SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35
), h AS (
  SELECT r, i, sha256(array_to_string(ws[i : i + 34], ' ')) AS h FROM p
), again AS (
  SELECT r, i FROM h SEMI JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)
), gone AS (
  SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM again) GROUP BY r
), k AS (
  SELECT doc_id, len(ws) AS n, coalesce(len(js), 0) AS n_removed, ws, js FROM d LEFT JOIN gone USING (r)
)
SELECT doc_id, n::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM k
""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
  SELECT r, vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS size FROM v
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), l AS (
  SELECT a.r AS u, b.r AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.93
), c(r, low) USING KEY (r) AS (
  SELECT r, vec_id FROM v
  UNION SELECT l.v, min(c.low) FROM c JOIN l ON l.u = c.r JOIN recurring.c o ON o.r = l.v WHERE c.low < o.low GROUP BY l.v
), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept FROM v JOIN c USING (r) LEFT JOIN n ON n.u = v.r
""",
    "op7_url_filters": """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rule, h, pre, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), m AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM q) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY host, path
)
SELECT q.page_id, q.host, q.path, m.rule,
       coalesce(m.verdict, CASE WHEN regexp_matches(lower(q.host || q.path), '(^|[^a-z0-9])(spam|casino|porn|xxx|malware|phishing)($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m ON q.host = m.host AND q.path = m.path
""",
}
