"""The media-library tables as views over the test tables, which hold no images.

``documents`` stand for files (their texts' MD5 for the content hash, so copies share one), ``labels``
for scores, ``embeddings`` for detector output and ``part`` names for window titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.views import name_table
from ..session import prepare


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document: N:1 to content hashes."""
    d = read(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    return d.select(
        F.concat(F.col("source"), F.lit("/"), doc, F.lit(".png")).alias("relative_path"),
        F.concat(F.lit("img"), doc, F.lit(".png")).alias("name"),
        F.col("source").alias("source_folder"),
        F.col("n_chars").alias("size"),
        (F.col("doc_id") * 1000).alias("modified_ms"),
        F.md5("text").alias("hash"),
    )


FILES_SQL = """files AS (
  SELECT source || '/' || doc_id || '.png' AS relative_path, 'img' || doc_id || '.png' AS name, source AS source_folder,
         n_chars AS size, doc_id * 1000 AS modified_ms, md5(text) AS hash FROM documents)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a hash; the facts of the smallest doc_id with that text.

    Scores come from ``toxic``, or are null without a label; words are counted for 9 of 10 records,
    so that every rule and every pending state occurs.
    """
    d = read(spark, sf_dir, "documents")
    words = F.size(F.filter(F.split("text", r"[ \n\t\r\f\x0b]+"), lambda x: x != ""))
    # One scan and one shuffle of a few numbers a document; the text itself isn't shuffled.
    docs = d.select(F.md5("text").alias("hash"), "doc_id", "n_chars", "source", words.alias("words"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("size"), F.max("source").alias("source"), F.min_by("words", "doc_id").alias("words"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    n = F.col("doc_id")
    counted = n % 10 != 9
    words_small = (F.col("words") % 71).cast("int")
    area = (F.col("words") % 11).cast("float") / F.lit(100.0).cast("float")
    rows = first.join(labels, "doc_id", "left")
    manual = n % 17 == 0
    auto_nsfw = n % 13 == 0
    return rows.select(
        "hash",
        F.concat(F.col("source"), F.lit("/"), n.cast("string"), F.lit(".png")).alias("last_known_path"),
        F.when(manual, F.concat(F.lit("Cat"), (n % 3).cast("string"))).when(auto_nsfw, "Explicit").when(n % 5 == 0, "High Text").alias("category"),
        F.when(manual, "manual").when(auto_nsfw, "auto-nsfw").when(n % 5 == 0, "auto").alias("classified_by"),
        F.when(manual | auto_nsfw | (n % 5 == 0), "2024-01-01T00:00:00.000Z").alias("classified_at"),
        F.when(counted, words_small).alias("ocr_word_count"),
        F.when(counted, area.cast("float")).alias("ocr_text_area_ratio"),
        F.when(n % 4 != 3, F.col("size").cast("int")).alias("ocr_text_chars"),
        F.when(F.col("toxic") == 1, F.lit(0.45).cast("float")).when(F.col("toxic") == 0, ((n % 9) / 20).cast("float")).alias("nsfw_score"),
        F.when(F.col("toxic").isNotNull(), F.array(F.concat(F.lit("quality "), F.col("quality").cast("string")))).alias("nsfw_labels"),
        F.when(n % 6 == 0, "").when(n % 6 < 4, F.concat(F.lit("Video "), (n % 40).cast("string"))).alias("video_title"),
        F.when(n % 7 == 0, F.lit(120)).alias("vision_desc_chars"),
        F.col("size").alias("size"),
        (n * 1000).alias("modified_ms"),
    )


RECORDS_SQL = r"""first_docs AS (SELECT md5(text) AS hash, min(doc_id) AS doc_id, max(n_chars) AS size, max(source) AS source FROM documents GROUP BY md5(text)),
word_counts AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \n\t\r\f\x0b]+'), lambda x: x <> '')) AS words FROM documents),
records AS (
  SELECT f.hash, f.source || '/' || f.doc_id || '.png' AS last_known_path,
    CASE WHEN f.doc_id % 17 = 0 THEN 'Cat' || (f.doc_id % 3) WHEN f.doc_id % 13 = 0 THEN 'Explicit' WHEN f.doc_id % 5 = 0 THEN 'High Text' END AS category,
    CASE WHEN f.doc_id % 17 = 0 THEN 'manual' WHEN f.doc_id % 13 = 0 THEN 'auto-nsfw' WHEN f.doc_id % 5 = 0 THEN 'auto' END AS classified_by,
    CASE WHEN f.doc_id % 17 = 0 OR f.doc_id % 13 = 0 OR f.doc_id % 5 = 0 THEN '2024-01-01T00:00:00.000Z' END AS classified_at,
    CASE WHEN f.doc_id % 10 <> 9 THEN CAST(w.words % 71 AS INTEGER) END AS ocr_word_count,
    CASE WHEN f.doc_id % 10 <> 9 THEN CAST(CAST(CAST(w.words % 11 AS FLOAT) AS DOUBLE) / 100 AS FLOAT) END AS ocr_text_area_ratio,
    CASE WHEN f.doc_id % 4 <> 3 THEN CAST(f.size AS INTEGER) END AS ocr_text_chars,
    CASE WHEN l.toxic = 1 THEN CAST(0.45 AS FLOAT) WHEN l.toxic = 0 THEN CAST(CAST(f.doc_id % 9 AS DOUBLE) / 20 AS FLOAT) END AS nsfw_score,
    CASE WHEN l.toxic IS NOT NULL THEN ['quality ' || l.quality] END AS nsfw_labels,
    CASE WHEN f.doc_id % 6 = 0 THEN '' WHEN f.doc_id % 6 < 4 THEN 'Video ' || (f.doc_id % 40) END AS video_title,
    CASE WHEN f.doc_id % 7 = 0 THEN 120 END AS vision_desc_chars, f.size, f.doc_id * 1000 AS modified_ms
  FROM first_docs f JOIN word_counts w ON f.doc_id = w.doc_id LEFT JOIN labels l ON f.doc_id = l.doc_id)"""

#: Folders that are kept out of analysis in the queries.
EXCLUDED = ("src1", "src7")
CATEGORIES = ("Cat0", "Cat1", "Explicit", "Low Text", "High Text", "Unused")


def names(spark: SparkSession, values: tuple[str, ...]) -> DataFrame:
    return name_table(spark, list(values))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    return d.withColumn("is_manual", F.col("name").endswith("3"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each vector as anchors of 18 classes, the last anchor cut short."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("hash"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("hash", F.expr("pos div 18").cast("int").alias("anchor"), (F.col("pos") % 18).alias("class"), F.abs("x").alias("score"))


DETECTIONS_SQL = """detections AS (
  SELECT hash, CAST((i - 1) // 18 AS INTEGER) AS anchor, CAST((i - 1) % 18 AS INTEGER) AS class, abs(x) AS score
  FROM (SELECT CAST(vec_id AS VARCHAR) AS hash, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a window title's ending, a different one or none for each key."""
    k = F.col("p_partkey") % 6
    end = F.when(k == 0, " - YouTube").when(k == 1, " – YouTube Music - x").when(k == 2, " — YOUTUBE").when(k == 3, "  - Vimeo").when(k == 4, ", HD - youtube - YouTube").otherwise(" - Notepad")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("hash"), F.concat(F.replace("p_name", F.lit(" "), F.lit("  ")), end).alias("raw"))


RAW_TITLES_SQL = """raw_titles AS (
  SELECT CAST(p_partkey AS VARCHAR) AS hash, replace(p_name, ' ', '  ') || CASE p_partkey % 6 WHEN 0 THEN ' - YouTube' WHEN 1 THEN ' – YouTube Music - x'
    WHEN 2 THEN ' — YOUTUBE' WHEN 3 THEN '  - Vimeo' WHEN 4 THEN ', HD - youtube - YouTube' ELSE ' - Notepad' END AS raw FROM part),
cut_titles AS (
  SELECT hash, raw, CASE
    WHEN regexp_matches(raw, '(?i) - youtube') THEN regexp_extract(raw, '(?is)^(.*?) - youtube', 1)
    WHEN regexp_matches(raw, '(?i) – youtube') THEN regexp_extract(raw, '(?is)^(.*?) – youtube', 1)
    WHEN regexp_matches(raw, '(?i) — youtube') THEN regexp_extract(raw, '(?is)^(.*?) — youtube', 1)
    WHEN regexp_matches(raw, '(?i) - vimeo') THEN regexp_extract(raw, '(?is)^(.*?) - vimeo', 1) END AS cut FROM raw_titles),
titled AS (SELECT hash, raw, nullif(trim(regexp_replace(cut, '\\s+', ' ', 'g')), '') AS title FROM cut_titles),
keyed AS (SELECT hash, title, trim(lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS key FROM titled WHERE title IS NOT NULL)"""
