"""The registered queries of this subpackage: thin contracts over the operators' own results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .langid import language
from .neardup_vectors import embedding_components
from .pieces import piece_digests
from .quality import quality
from .simhash import simhash_components
from .storage import table
from .token_files import token_digests
from .toxicity import toxicity
from .urlfilter import filter_urls, host_of
from .wordpiece import token_counts

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2)


def dated_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of ``pages``, by rule from the host's MD5: the tables hold no list."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    entry = lambda name, pattern, action, n, when: F.when(when, F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("day")))
    host, n = F.col("host"), F.col("n")
    parent = F.regexp_replace(host, r"^[^.]*\.", "")
    rules = [
        entry("ads", host, "add", n % 400, n % 3 == 0),
        entry("ads", host, "remove", n % 400 + 90 + n % 200, n % 6 == 0),
        entry("ads", host, "add", n % 400 + 400, n % 12 == 0),
        entry("malware", parent, "add", n % 500, (n % 11 == 0) & (F.size(F.split(host, r"\.")) > 3)),
        entry("malware", parent, "remove", n % 500 + 60, (n % 22 == 0) & (F.size(F.split(host, r"\.")) > 3)),
        entry("regional", F.concat(host, F.lit("/de")), "add", n % 300, n % 2 == 0),
    ]
    return hosts.select(F.explode(F.array_compact(F.array(*rules))).alias("e")).select("e.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page evaluated on a fetch day that follows from its id, against the lists of dated_entries."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 900).cast("int"))
    out = filter_urls(pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched")), dated_entries(pages))
    return out.select(F.col("id").alias("page_id"), "host", "fetched", F.array_join("lists", ",").alias("lists"), "matched", "blocked")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_token_files, op3_url_filter, op4_token_counts, op5_decontaminate, op6_pieces, op7_quality, op8_language, op9_embeddings, op10_toxicity)}

ORACLES: dict[str, str] = {
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 7919 % 900 AS INTEGER) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '\.$', ''), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)', 1) AS seg
  FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS n FROM p WHERE host IS NOT NULL),
e AS (
  SELECT 'ads' AS list, host AS pattern, 'add' AS action, n % 400 AS k FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'ads', host, 'remove', n % 400 + 90 + n % 200 FROM h WHERE n % 6 = 0
  UNION ALL SELECT 'ads', host, 'add', n % 400 + 400 FROM h WHERE n % 12 = 0
  UNION ALL SELECT 'malware', regexp_replace(host, '^[^.]*\.', ''), 'add', n % 500 FROM h WHERE n % 11 = 0 AND len(string_split(host, '.')) > 3
  UNION ALL SELECT 'malware', regexp_replace(host, '^[^.]*\.', ''), 'remove', n % 500 + 60 FROM h WHERE n % 22 = 0 AND len(string_split(host, '.')) > 3
  UNION ALL SELECT 'regional', host || '/de', 'add', n % 300 FROM h WHERE n % 2 = 0),
q AS (
  SELECT page_id, fetched, host, unnest(list_distinct(list_concat(
           CASE WHEN host LIKE '[%' THEN [host] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END,
           CASE WHEN seg <> '' THEN [host || '/' || seg] ELSE [] END))) AS pattern
  FROM p WHERE host IS NOT NULL),
d AS (SELECT list, pattern, k, bool_or(action = 'add') AS is_on FROM e GROUP BY ALL),
a AS (
  SELECT q.page_id, q.pattern, d.list, d.is_on, row_number() OVER (PARTITION BY q.page_id, q.pattern, d.list ORDER BY d.k DESC) AS r
  FROM q JOIN d ON q.pattern = d.pattern AND DATE '2024-01-01' + CAST(d.k AS INTEGER) <= q.fetched),
v AS (
  SELECT page_id, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, arg_min(pattern, (-length(pattern), pattern)) AS matched
  FROM a WHERE r = 1 AND is_on GROUP BY page_id)
SELECT p.page_id, p.host, p.fetched, coalesce(v.lists, '') AS lists, v.matched, v.matched IS NOT NULL AS blocked
FROM p LEFT JOIN v ON p.page_id = v.page_id
""",
    "op5_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
spans AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS span
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT s.doc_id, s.i, s.k, x.item_id FROM spans s JOIN windows x ON s.k = x.k AND s.span = x.span),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS digest FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
    "op9_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS one, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS one, vec_id AS other FROM embeddings UNION SELECT r.one, l.other FROM reach r JOIN links l ON r.other = l.one),
least AS (SELECT one AS vec_id, min(other) AS component_id FROM reach GROUP BY one),
n AS (SELECT one AS vec_id, count(*) AS n FROM links GROUP BY one)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
""",
}
