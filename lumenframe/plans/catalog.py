"""The registered queries of the media library, each with its DuckDB oracle where SQL can express it.

All run over whole tables; limits occur only where they are the operator (viewport, samples, top classes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FOLDER_PATTERNS
from ..functions import numbers, paths, text
from ..operators import classify as rules
from ..operators import detector, edits, ocr, passes, reconcile, videos
from ..operators import views as shown
from ..sources import legacy
from . import views as V

NOW = "2026-01-01T00:00:00.000Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query under its function's name, with its oracle over the named common tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ",\n".join(views) + "\n" if views else "") + sql.strip()
        return f

    return register


def _values(items: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in items) + ")"


EXCLUDED_SQL = f"excluded AS (SELECT * FROM {_values(V.EXCLUDED)} t(name))"
CATEGORIES_SQL = f"categories AS (SELECT * FROM {_values(V.CATEGORIES)} t(name))"
FOLDERS_SQL = "folders AS (SELECT DISTINCT source AS name, source LIKE '%3' AS is_manual FROM documents)"
VIEW_SQL = """lib AS (
  SELECT f.*, r.category, r.classified_by, r.classified_at, r.ocr_word_count, r.ocr_text_area_ratio, r.ocr_text_chars,
         r.nsfw_score, r.nsfw_labels, nullif(r.video_title, '') AS video_title, r.vision_desc_chars
  FROM files f LEFT JOIN records r ON f.hash = r.hash)"""
LIB = (V.FILES_SQL, V.RECORDS_SQL, VIEW_SQL)

#: The two rules in order, over columns category, classified_by, classified_at, s (score), w (words), a (area).
SCORE_STEP = """scored AS (
  SELECT *, CASE WHEN classified_by IS NOT DISTINCT FROM 'manual' OR nsfw_score IS NULL THEN 0
       WHEN nsfw_score >= CAST({score} AS FLOAT) THEN CASE WHEN category IS NOT DISTINCT FROM 'Explicit' THEN 0 ELSE 1 END
       WHEN classified_by IS NOT DISTINCT FROM 'auto-nsfw' THEN 2 ELSE 0 END AS step FROM {source}),
after_score AS (
  SELECT * REPLACE (
    CASE step WHEN 1 THEN 'Explicit' WHEN 2 THEN NULL ELSE category END AS category,
    CASE step WHEN 1 THEN 'auto-nsfw' WHEN 2 THEN NULL ELSE classified_by END AS classified_by,
    CASE step WHEN 1 THEN '{now}' WHEN 2 THEN NULL ELSE classified_at END AS classified_at) FROM scored)"""
TEXT_STEP = """texted AS (
  SELECT *, CASE WHEN ocr_word_count <= {words} AND ocr_text_area_ratio <= CAST({area} AS FLOAT) THEN 'Low Text' ELSE 'High Text' END AS wanted FROM {source}),
moved AS (
  SELECT *, CASE WHEN classified_by IS NOT DISTINCT FROM 'manual' THEN 0
    WHEN nsfw_score >= CAST({score} AS FLOAT) THEN CASE WHEN category IS NOT DISTINCT FROM 'Explicit' THEN 0 ELSE 1 END
    WHEN ocr_word_count IS NULL OR ocr_text_area_ratio IS NULL OR category IS NOT DISTINCT FROM wanted THEN 0 ELSE 2 END AS move FROM texted),
after_text AS (
  SELECT * REPLACE (
    CASE move WHEN 1 THEN 'Explicit' WHEN 2 THEN wanted ELSE category END AS category,
    CASE move WHEN 1 THEN 'auto-nsfw' WHEN 2 THEN 'auto' ELSE classified_by END AS classified_by,
    CASE move WHEN 0 THEN classified_at ELSE '{now}' END AS classified_at) FROM moved)"""
DEFAULTS = {"score": 0.45, "words": 35, "area": 0.05, "now": NOW}
SCORE_SQL = SCORE_STEP.format(source="records", **DEFAULTS)
TEXT_SQL = TEXT_STEP.format(source="records", **DEFAULTS)
FULL_SQL = SCORE_SQL + ",\n" + TEXT_STEP.format(source="after_score", **DEFAULTS)
STATE_COLUMNS = ("hash", "category", "classified_by", "classified_at")


def _view(spark: SparkSession, d: str) -> DataFrame:
    return shown.library_view(V.files(spark, d), V.records(spark, d))


def _classified(spark: SparkSession, d: str, **kind) -> DataFrame:
    return rules.classify(V.records(spark, d), F.lit(NOW), **kind)


# --- views and counts ---------------------------------------------------------------------------


@query("SELECT * FROM lib", LIB)
def library_view(spark, d):
    return _view(spark, d)


@query(
    "SELECT c.name, CAST(coalesce(n, 0) AS BIGINT) AS image_count FROM categories c LEFT JOIN (SELECT r.category, count(*) AS n FROM files f JOIN after_text r ON f.hash = r.hash GROUP BY 1) x ON c.name = x.category",
    (V.FILES_SQL, V.RECORDS_SQL, CATEGORIES_SQL, FULL_SQL),
)
def library_counts_by_category(spark, d):
    view = shown.library_view(V.files(spark, d), _classified(spark, d))
    return shown.category_counts(view, V.names(spark, V.CATEGORIES))


@query(
    "SELECT f.name, f.is_manual, false AS is_root, count(l.hash) AS image_count, f.name IN (SELECT name FROM excluded) AS excluded FROM folders f LEFT JOIN files l ON f.name = l.source_folder GROUP BY f.name, f.is_manual",
    (V.FILES_SQL, FOLDERS_SQL, EXCLUDED_SQL),
)
def folder_counts(spark, d):
    return shown.folder_counts(V.files(spark, d), V.folders(spark, d), V.names(spark, V.EXCLUDED))


@query("SELECT count(*) AS unclassified FROM lib WHERE category IS NULL", LIB)
def unclassified_count(spark, d):
    return shown.unclassified_count(_view(spark, d))


@query(
    "SELECT c.name, CAST(coalesce(n, 0) AS BIGINT) AS image_count FROM categories c LEFT JOIN (SELECT category, count(*) AS n FROM lib WHERE source_folder NOT IN (SELECT name FROM excluded) GROUP BY 1) x ON c.name = x.category",
    (*LIB, CATEGORIES_SQL, EXCLUDED_SQL),
)
def included_counts(spark, d):
    inside = shown.included(_view(spark, d), V.folders(spark, d), V.names(spark, V.EXCLUDED))
    return shown.category_counts(inside, V.names(spark, V.CATEGORIES))


@query("SELECT relative_path, name, category, modified_ms FROM lib WHERE category IS NULL AND contains(lower(name || ' ' || relative_path), 'src1') ORDER BY name", LIB)
def search_sort_name(spark, d):
    found = shown.filtered(_view(spark, d), "unclassified", query=" SRC1 ")
    return found.orderBy(*shown.order("name")).select("relative_path", "name", "category", "modified_ms")


@query("SELECT relative_path, name, size FROM lib WHERE category = 'High Text' AND contains(lower(name || ' ' || relative_path), 'img1')", LIB)
def search_sort_size(spark, d):
    found = shown.filtered(_view(spark, d), "category", "High Text", "IMG1")
    return found.orderBy(*shown.order("size")).select("relative_path", "name", "size")


def _placed(rows: DataFrame, kind: str, start: int) -> DataFrame:
    """The few rows of a viewport with their places, so that their order is compared too."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*shown.order(kind))).cast("long") + start)


@query("SELECT relative_path, name, modified_ms, row_number() OVER (ORDER BY modified_ms DESC, name, relative_path) AS place FROM files ORDER BY place LIMIT 60 OFFSET 40", (V.FILES_SQL,))
def viewport_slice(spark, d):
    return _placed(shown.viewport(V.files(spark, d), "library", 40, 100), "library", 40).select("relative_path", "name", "modified_ms", "place")


@query("SELECT relative_path, name, row_number() OVER (ORDER BY modified_ms DESC, CAST(regexp_extract(name, '[0-9]+') AS BIGINT), relative_path) AS place FROM files ORDER BY place LIMIT 80", (V.FILES_SQL,))
def viewport_newest(spark, d):
    return _placed(shown.viewport(V.files(spark, d), "newest", 0, 80), "newest", 0).select("relative_path", "name", "place")


@query("SELECT relative_path, name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '[0-9]+') AS BIGINT), relative_path) AS place FROM files ORDER BY place LIMIT 100 OFFSET 5", (V.FILES_SQL,))
def viewport_by_name(spark, d):
    return _placed(shown.viewport(V.files(spark, d), "name", 5, 105), "name", 5).select("relative_path", "name", "place")


@query("SELECT relative_path, size, row_number() OVER (ORDER BY size DESC, CAST(regexp_extract(name, '[0-9]+') AS BIGINT), relative_path) AS place FROM files ORDER BY place LIMIT 50 OFFSET 10", (V.FILES_SQL,))
def viewport_by_size(spark, d):
    return _placed(shown.viewport(V.files(spark, d), "size", 10, 60), "size", 10).select("relative_path", "size", "place")


@query("SELECT name, row_number() OVER (ORDER BY lower(name), name) AS place FROM categories", (CATEGORIES_SQL,))
def categories_sorted(spark, d):
    names = V.names(spark, V.CATEGORIES)  # a handful of names
    return names.select("name", F.row_number().over(Window.orderBy(F.lower("name"), "name")).cast("long").alias("place"))


# --- reconcile ----------------------------------------------------------------------------------

# A rescan: one file in seven is gone, one in five has grown, and new files stand beside the old ones.
RESCAN_SQL = """rescan AS (
  SELECT relative_path, name, source_folder, CASE WHEN modified_ms % 5000 = 0 THEN size + 1 ELSE size END AS size, modified_ms,
         CASE WHEN modified_ms % 5000 = 0 THEN md5(hash) ELSE hash END AS hash FROM files WHERE modified_ms % 7000 <> 0 AND source_folder NOT IN ('src2', 'src3'))"""


def _rescan(spark, d):
    f = V.files(spark, d).where("modified_ms % 7000 <> 0").where(~F.col("source_folder").isin("src2", "src3"))
    edited = F.col("modified_ms") % 5000 == 0
    return f.withColumn("size", F.when(edited, F.col("size") + 1).otherwise(F.col("size"))).withColumn("hash", F.when(edited, F.md5("hash")).otherwise(F.col("hash")))


SCANNED = [f"src{i}" for i in range(20) if i not in (2, 3)]
INDEX_SQL = "idx AS (SELECT last_known_path AS relative_path, size, modified_ms, max(hash) AS hash FROM records WHERE size IS NOT NULL AND modified_ms IS NOT NULL AND last_known_path <> '' GROUP BY 1, 2, 3)"
UPSERT_SQL = """winners AS (SELECT hash, max_by(struct_pack(p := relative_path, s := size, m := modified_ms), relative_path) AS w FROM rescan GROUP BY hash),
upserted AS (
  SELECT coalesce(r.hash, w.hash) AS hash, coalesce(w.w.p, r.last_known_path) AS last_known_path, coalesce(w.w.s, r.size) AS size,
         coalesce(w.w.m, r.modified_ms) AS modified_ms, r.category, r.ocr_word_count, w.hash IS NOT NULL AS seen
  FROM records r FULL JOIN winners w ON r.hash = w.hash)"""
PATH_FOLDER = "CASE WHEN instr({p}, '/') > 0 THEN split_part({p}, '/', 1) ELSE 'Root' END"


@query("SELECT r.relative_path, r.size, r.modified_ms, i.hash FROM rescan r LEFT JOIN idx i ON r.relative_path = i.relative_path AND r.size = i.size AND r.modified_ms = i.modified_ms", (V.FILES_SQL, V.RECORDS_SQL, RESCAN_SQL, INDEX_SQL))
def hash_reuse_join(spark, d):
    reused = reconcile.reuse_hashes(_rescan(spark, d), reconcile.hash_index(V.records(spark, d)))
    return reused.select("relative_path", "size", "modified_ms", "hash")


@query("SELECT * FROM upserted", (V.FILES_SQL, V.RECORDS_SQL, RESCAN_SQL, UPSERT_SQL))
def upsert_last_wins(spark, d):
    return reconcile.upsert(V.records(spark, d), _rescan(spark, d)).select("hash", "last_known_path", "size", "modified_ms", "category", "ocr_word_count", "seen")


@query(f"SELECT hash, last_known_path, category FROM upserted WHERE seen OR (last_known_path <> '' AND {PATH_FOLDER.format(p='last_known_path')} IN ('src2', 'src3'))", (V.FILES_SQL, V.RECORDS_SQL, RESCAN_SQL, UPSERT_SQL))
def purge_semi_anti(spark, d):
    folders = V.names(spark, tuple(SCANNED))
    return reconcile.purge(reconcile.upsert(V.records(spark, d), _rescan(spark, d)), folders).select("hash", "last_known_path", "category")


@query(
    f"SELECT hash, last_known_path, category FROM upserted WHERE seen OR (last_known_path <> '' AND {PATH_FOLDER.format(p='last_known_path')} IN ('src2', 'src3'))",
    (V.FILES_SQL, V.RECORDS_SQL, RESCAN_SQL, UPSERT_SQL),
)
def reconcile_scan(spark, d):
    return reconcile.reconcile(V.records(spark, d), _rescan(spark, d), SCANNED).select("hash", "last_known_path", "category")


@query(
    "SELECT hash, CASE WHEN category IN (SELECT name FROM categories) THEN category END AS category, CASE WHEN category IS NULL OR category IN (SELECT name FROM categories) THEN classified_by END AS classified_by, classified_at FROM records",
    (V.RECORDS_SQL, CATEGORIES_SQL),
)
def invalidate_category(spark, d):
    return rules.invalidate_categories(V.records(spark, d), V.names(spark, V.CATEGORIES)).select(*STATE_COLUMNS)


MERGE_SQL = "updates AS (SELECT md5(text) AS hash, CAST(max(struct_pack(a := doc_id % 50, b := n_chars % 7)).a AS INTEGER) AS wc, max(struct_pack(a := doc_id % 50, b := n_chars % 7)).b AS area FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)"


@query(
    "SELECT r.hash, CASE WHEN u.hash IS NULL THEN r.ocr_word_count ELSE u.wc END AS ocr_word_count, CASE WHEN u.hash IS NULL THEN r.ocr_text_area_ratio ELSE CAST(u.area AS FLOAT) END AS ocr_text_area_ratio, r.category FROM records r LEFT JOIN updates u ON r.hash = u.hash",
    (V.RECORDS_SQL, MERGE_SQL),
)
def merge_results(spark, d):
    docs = V.read(spark, d, "documents").where("doc_id % 3 = 0")
    updates = docs.select(F.md5("text").alias("hash"), (F.col("doc_id") % 50).cast("int").alias("ocr_word_count"), (F.col("n_chars") % 7).cast("float").alias("ocr_text_area_ratio"))
    extra = spark.createDataFrame([("unknown", 1, 1.0)], "hash string, ocr_word_count int, ocr_text_area_ratio float")
    return reconcile.merge_columns(V.records(spark, d), updates.unionByName(extra), ["ocr_word_count", "ocr_text_area_ratio"]).select("hash", "ocr_word_count", "ocr_text_area_ratio", "category")


# --- classification -----------------------------------------------------------------------------


@query("SELECT hash, category, classified_by, classified_at FROM after_score", (V.RECORDS_SQL, SCORE_SQL))
def classify_nsfw(spark, d):
    return _classified(spark, d, rules=("score",)).select(*STATE_COLUMNS)


@query("SELECT hash, category, classified_by, classified_at FROM after_text", (V.RECORDS_SQL, TEXT_SQL))
def classify_text(spark, d):
    return _classified(spark, d, rules=("text",)).select(*STATE_COLUMNS)


@query(
    "SELECT hash, CASE WHEN category IN (SELECT name FROM categories) THEN category END AS category, CASE WHEN category IS NULL OR category IN (SELECT name FROM categories) THEN classified_by END AS classified_by, classified_at FROM after_text",
    (V.RECORDS_SQL, CATEGORIES_SQL, FULL_SQL),
)
def classify_full(spark, d):
    return rules.invalidate_categories(_classified(spark, d), list(V.CATEGORIES)).select(*STATE_COLUMNS)


SWEEP = ((10, 0.02, 0.3), (35, 0.05, 0.45), (60, 0.08, 0.45), (35, 0.05, 0.9))
SWEEP_SQL = "sweep AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {w}, CAST({a} AS FLOAT), CAST({s} AS FLOAT))" for i, (w, a, s) in enumerate(SWEEP)) + ") t(k, tw, ta, ts)), crossed AS (SELECT * FROM records CROSS JOIN sweep)"
SWEPT_SQL = SCORE_STEP.format(source="crossed", **{**DEFAULTS, "score": "ts"}) + ",\n" + TEXT_STEP.format(source="after_score", **{**DEFAULTS, "score": "ts", "words": "tw", "area": "ta"})


@query("SELECT k, category, count(*) AS n FROM after_text GROUP BY k, category", (V.RECORDS_SQL, SWEEP_SQL, SWEPT_SQL))
def threshold_sweep(spark, d):
    """Counts under several thresholds at once, without any inference; a handful of threshold rows is broadcast."""
    sweep = spark.createDataFrame([(i, *x) for i, x in enumerate(SWEEP)], "k int, tw int, ta float, ts float")
    crossed = V.records(spark, d).crossJoin(F.broadcast(sweep))
    return rules.classify(crossed, F.lit(NOW), F.col("tw"), F.col("ta"), F.col("ts")).groupBy("k", "category").agg(F.count("*").alias("n"))


@query("SELECT bool_or(nsfw_score IS NOT NULL) AS has_score, bool_or(ocr_word_count IS NOT NULL) AS has_text FROM records", (V.RECORDS_SQL,))
def classification_gates(spark, d):
    return rules.gates(V.records(spark, d))


# --- passes -------------------------------------------------------------------------------------


def _pending(name):
    return lambda spark, d: passes.pending(_view_raw(spark, d), passes.PASSES[name], list(V.EXCLUDED)).select("hash", "relative_path")


PENDING_VIEWS = (V.FILES_SQL, V.RECORDS_SQL, EXCLUDED_SQL)
_KEPT = "(SELECT * FROM records WHERE substr(hash, 1, 1) <> '0')"
RAW_LIB_SQL = f"raw_lib AS (SELECT f.*, r.* EXCLUDE (hash, size, modified_ms) FROM files f LEFT JOIN {_KEPT} r ON f.hash = r.hash WHERE f.source_folder NOT IN (SELECT name FROM excluded))"


def _view_raw(spark, d):
    """The view with video titles as they are stored, some files being without a record yet."""
    records = V.records(spark, d).where(F.substring("hash", 1, 1) != "0")
    return V.files(spark, d).join(records.select("hash", *shown.CARRIED), "hash", "left")


for _name, _where in (
    ("nsfw", "nsfw_score IS NULL"),
    ("chunk", "video_title IS NULL"),
    ("text", "ocr_word_count IS NULL AND coalesce(nsfw_score < CAST(0.45 AS FLOAT), true)"),
    ("extract", "ocr_text_chars IS NULL"),
    ("vision", "vision_desc_chars IS NULL AND coalesce(nsfw_score < CAST(0.45 AS FLOAT), false)"),
):
    _f = _pending(_name)
    _f.__name__ = f"pending_{_name}"
    query(f"SELECT hash, relative_path FROM raw_lib WHERE {_where}", (*PENDING_VIEWS, RAW_LIB_SQL))(_f)


# Two titled frames in three belong to the sample in these queries.
VIDEO_SQL = """video_titles AS (SELECT hash, video_title AS title, trim(lower(regexp_replace(video_title, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS key FROM records WHERE video_title <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(hash), hash) AS r FROM video_titles),
plan AS (SELECT key, arg_min(title, hash) AS title, list_sort(list(hash)) AS member_hashes, list_sort(list(hash) FILTER (WHERE r <= 3)) AS selected_hashes FROM ranked GROUP BY key),
members AS (SELECT hash, max(chosen) AS chosen FROM (SELECT unnest(member_hashes) AS hash, 0 AS chosen FROM plan UNION ALL SELECT unnest(selected_hashes), 1 FROM plan) GROUP BY hash),
eligible AS (SELECT l.*, coalesce(m.chosen = 0, false) AS unsampled FROM raw_lib l LEFT JOIN members m ON l.hash = m.hash)"""


def _plan(spark, d):
    return videos.build_plan(V.records(spark, d).select("hash", F.col("video_title").alias("title")), 3)


@query(
    "SELECT * FROM (SELECT CASE WHEN unsampled THEN 'video' WHEN nsfw_score >= CAST(0.45 AS FLOAT) THEN 'explicit' WHEN nsfw_score IS NULL THEN 'unscored' END AS reason, count(*) AS n FROM eligible GROUP BY 1) WHERE reason IS NOT NULL",
    (*PENDING_VIEWS, RAW_LIB_SQL, VIDEO_SQL),
)
def skip_reasons(spark, d):
    return passes.skip_counts(_view_raw(spark, d), _plan(spark, d), list(V.EXCLUDED))


@query("SELECT hash, relative_path FROM eligible WHERE NOT unsampled AND nsfw_score < CAST(0.45 AS FLOAT) AND vision_desc_chars IS NULL", (*PENDING_VIEWS, RAW_LIB_SQL, VIDEO_SQL))
def vision_eligible(spark, d):
    return passes.vision_eligible(_view_raw(spark, d), _plan(spark, d), list(V.EXCLUDED)).select("hash", "relative_path")


@query("SELECT last_known_path AS relative_path, hash FROM records WHERE vision_desc_chars IS NOT NULL AND last_known_path <> ''", (V.RECORDS_SQL,))
def vision_index(spark, d):
    return videos.description_index(V.records(spark, d))


# --- video titles and plans ---------------------------------------------------------------------


@query("SELECT hash, title FROM titled", (V.RAW_TITLES_SQL,))
def clean_title(spark, d):
    return V.raw_titles(spark, d).select("hash", text.clean_title(F.col("raw")).alias("title"))


@query("SELECT hash, key FROM keyed", (V.RAW_TITLES_SQL,))
def group_key(spark, d):
    titled = V.raw_titles(spark, d).select("hash", text.clean_title(F.col("raw")).alias("title")).where("title is not null")
    return titled.select("hash", text.group_key(F.col("title")).alias("key"))


TITLE_PLAN_SQL = """title_ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(hash), hash) AS r FROM keyed WHERE key <> ''),
title_plan AS (SELECT key, arg_min(title, hash) AS title, list_sort(list(hash)) AS member_hashes, list_sort(list(hash) FILTER (WHERE r <= 10)) AS selected_hashes FROM title_ranked GROUP BY key)"""
JOINED_PLAN = "SELECT key, title, array_to_string(member_hashes, ',') AS members, array_to_string(selected_hashes, ',') AS selected FROM "


def _title_plan(spark, d, **kind):
    titled = V.raw_titles(spark, d).select("hash", text.clean_title(F.col("raw")).alias("title"))
    return videos.build_plan(titled, 10, **kind)


def _joined(plan):
    return plan.select("key", "title", F.array_join("member_hashes", ",").alias("members"), F.array_join("selected_hashes", ",").alias("selected"))


@query(JOINED_PLAN + "title_plan", (V.RAW_TITLES_SQL, TITLE_PLAN_SQL))
def chunk_plan(spark, d):
    return _joined(videos.plan_ordered(_title_plan(spark, d)))


STICKY_SQL = """previous AS (SELECT key, list_concat(list_reverse(list_slice(member_hashes, 1, 4)), ['gone']) AS before FROM title_plan WHERE length(key) % 3 <> 0),
sticky AS (SELECT t.key, t.title, t.member_hashes, list_filter(p.before, lambda x: list_contains(t.member_hashes, x)) AS kept, t.selected_hashes FROM title_plan t LEFT JOIN previous p ON t.key = p.key)"""


@query("SELECT key, title, array_to_string(member_hashes, ',') AS members, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE selected_hashes END, ',') AS selected FROM sticky", (V.RAW_TITLES_SQL, TITLE_PLAN_SQL, STICKY_SQL))
def chunk_plan_sticky(spark, d):
    """Two groups in three had the last of their first four members selected, and one frame that is gone."""
    before = _title_plan(spark, d).where(F.length("key") % 3 != 0)
    before = before.select("title", F.array_append(F.reverse(F.slice("member_hashes", 1, 4)), F.lit("gone")).alias("selected_hashes"))
    return _joined(_title_plan(spark, d, previous=before))


@query("SELECT count(*) AS groups, CAST(sum(len(member_hashes)) AS BIGINT) AS members, CAST(sum(len(selected_hashes)) AS BIGINT) AS selected FROM title_plan", (V.RAW_TITLES_SQL, TITLE_PLAN_SQL))
def chunk_summary(spark, d):
    return videos.plan_summary(_title_plan(spark, d))


@query(
    r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(lower(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[^\p{L}\p{N}]+', ' ', 'g'))) AS key FROM pages"
)
def html_title_keys(spark, d):
    raw = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return V.read(spark, d, "pages").select("page_id", text.collapse_spaces(raw).alias("title"), text.group_key(raw).alias("key"))


# --- detector and recognized text ---------------------------------------------------------------

MAXIMA_SQL = "maxima AS (SELECT hash, class, greatest(CAST(0 AS FLOAT), max(score) FILTER (WHERE NOT isnan(score))) AS score FROM detections GROUP BY hash, class)"
CLASS_LIST = "[" + ", ".join(f"'{x}'" for x in detector.DETECTOR_CLASSES) + "]"
EXPLICIT_LIST = ", ".join(map(str, detector.EXPLICIT_CLASSES))


def _maxima(spark, d):
    return detector.class_maxima(V.detections(spark, d))


@query("SELECT * FROM maxima", (V.DETECTIONS_SQL, MAXIMA_SQL))
def detector_class_max(spark, d):
    return _maxima(spark, d)


@query(f"SELECT hash, greatest(CAST(0 AS FLOAT), max(score) FILTER (WHERE class IN ({EXPLICIT_LIST}))) AS nsfw_score FROM maxima GROUP BY hash", (V.DETECTIONS_SQL, MAXIMA_SQL))
def detector_explicit_score(spark, d):
    return detector.explicit_scores(_maxima(spark, d))


@query("SELECT hash, rank, class, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY hash ORDER BY score DESC, class) AS INTEGER) AS rank FROM maxima) WHERE rank <= 6 AND score >= CAST(0.01 AS FLOAT)", (V.DETECTIONS_SQL, MAXIMA_SQL))
def detector_top6(spark, d):
    return detector.top_classes(_maxima(spark, d))


LABEL = f"{CLASS_LIST}[class + 1] || ' ' || CAST(round_even(CAST(score * CAST(100 AS FLOAT) AS DOUBLE), 0) AS BIGINT) || '%'"


@query(
    f"""SELECT hash, array_to_string(list(label ORDER BY part, place), '; ') AS labels FROM (
  SELECT hash, 0 AS part, class AS place, 'explicit ' || {LABEL} AS label FROM maxima WHERE class IN ({EXPLICIT_LIST}) AND score >= CAST(0.25 AS FLOAT)
  UNION ALL SELECT hash, 1, rank, 'top ' || {LABEL} FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY score DESC, class) AS rank FROM maxima) WHERE rank <= 6 AND score >= CAST(0.01 AS FLOAT)) GROUP BY hash""",
    (V.DETECTIONS_SQL, MAXIMA_SQL),
)
def detector_labels(spark, d):
    return detector.labels(_maxima(spark, d)).select("hash", F.array_join("nsfw_labels", "; ").alias("labels"))


# A turn stands for a line, its tokens for words whose boxes follow from their lengths.
LINES_SQL = "ocr_lines AS (SELECT CAST(conv_id AS VARCHAR) AS hash, turn AS line_no, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS words FROM conversations)"


def _lines(spark, d):
    c = V.read(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("hash"), F.col("turn").alias("line_no"), "text", F.filter(F.split("text", " "), lambda x: x != "").alias("words"))


@query(
    "SELECT hash, CAST(count(*) AS INTEGER) AS ocr_word_count, CAST(greatest(0.0, least(1.0, sum(length(w) * 2.0) / 1000.0)) AS FLOAT) AS ocr_text_area_ratio FROM (SELECT hash, unnest(words) AS w FROM ocr_lines) GROUP BY hash",
    (LINES_SQL,),
)
def ocr_stats(spark, d):
    words = _lines(spark, d).select("hash", F.explode("words").alias("w"))
    return ocr.word_stats(words.select("hash", F.lit(50.0).alias("image_width"), F.lit(20.0).alias("image_height"), F.length("w").cast("double").alias("width"), F.lit(2.0).alias("height")))


@query("SELECT hash, array_to_string(list(text ORDER BY line_no), chr(10)) AS text FROM ocr_lines GROUP BY hash", (LINES_SQL,))
def ocr_text_join(spark, d):
    return ocr.joined_lines(_lines(spark, d).select("hash", "line_no", "text"))


@query(
    "SELECT hash, array_to_string(coalesce(list(text ORDER BY line_no) FILTER (WHERE len(words) > 0 AND line_no * 3 <= greatest(CAST(100 AS FLOAT) * CAST(0.06 AS FLOAT), 1)), []), ' ') AS strip FROM ocr_lines GROUP BY hash",
    (LINES_SQL,),
)
def title_strip(spark, d):
    lines = _lines(spark, d)
    boxes = F.transform("words", lambda w: F.struct((F.col("line_no") * 3 + F.length(w) - F.length(w)).cast("float").alias("y"), F.length(w).cast("float").alias("width"), F.lit(2.0).cast("float").alias("height")))
    results = lines.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", boxes.alias("words")))).alias("lines"))
    return results.withColumn("height", F.lit(100.0).cast("float")).select("hash", ocr.title_strip().alias("strip"))


# --- paths, names and folders -------------------------------------------------------------------


@query(f"SELECT url, {PATH_FOLDER.format(p='p')} AS folder, split_part(p, '/', -1) AS name FROM (SELECT url, regexp_replace(replace(url, '\\', '/'), '^[a-z]+://', '') AS p FROM pages)")
def source_folder_of(spark, d):
    pages = V.read(spark, d, "pages").select("url", F.regexp_replace(paths.slashes(F.col("url")), "^[a-z]+://", "").alias("p"))
    return pages.select("url", paths.source_folder(F.col("p")).alias("folder"), paths.file_name(F.col("p")).alias("name"))


@query(
    "SELECT doc_id, name FROM (SELECT doc_id, 'f' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' WHEN 2 THEN '.heic' WHEN 3 THEN '' WHEN 4 THEN '.jpeg.bak' WHEN 5 THEN '.Tif' WHEN 6 THEN '.' ELSE '.webp' END AS name FROM documents) WHERE regexp_matches(name, '(?i)^.+\\.(jpg|jpeg|png|gif|bmp|webp|tiff|tif|heic|heif)$')"
)
def image_ext_filter(spark, d):
    doc = F.col("doc_id")
    k = doc % 8
    end = F.when(k == 0, ".PNG").when(k == 1, ".txt").when(k == 2, ".heic").when(k == 3, "").when(k == 4, ".jpeg.bak").when(k == 5, ".Tif").when(k == 6, ".").otherwise(".webp")
    named = V.read(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), doc.cast("string"), end).alias("name"))
    return named.where(paths.is_image(F.col("name")))


@query("SELECT doc_id, path FROM (SELECT doc_id, source || repeat('/d', CAST(doc_id % 7 AS INTEGER)) || CASE WHEN doc_id % 11 = 0 THEN '/.hid' ELSE '' END || '/' || doc_id || '.png' AS path FROM documents) WHERE len(string_split(path, '/')) - 2 <= 4 AND NOT contains(path, '/.')")
def depth_filter(spark, d):
    doc = F.col("doc_id")
    path = F.concat(F.col("source"), F.repeat(F.lit("/d"), (doc % 7).cast("int")), F.when(doc % 11 == 0, "/.hid").otherwise(""), F.lit("/"), doc.cast("string"), F.lit(".png"))
    return V.read(spark, d, "documents").select("doc_id", path.alias("path")).where(paths.in_scan(F.col("path")))


@query(
    """SELECT folder, by_month, by_name, by_hand FROM (
  SELECT DISTINCT folder, regexp_matches(folder, '^\\d{4}-\\d{2}$') AS by_month, regexp_matches(folder, '(?i)^(January|February|March|April|May|June|July|August|September|October|November|December) \\d{4}$') AS by_name, folder = '1995-03-x' AS by_hand
  FROM (SELECT strftime(o_orderdate, '%Y-%m') AS folder FROM orders UNION ALL SELECT strftime(o_orderdate, '%B %Y') FROM orders UNION ALL SELECT strftime(o_orderdate, '%Y-%m') || '-x' FROM orders))"""
)
def folder_pattern_match(spark, d):
    o = V.read(spark, d, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    folder = F.explode(F.array(month, F.date_format("o_orderdate", "MMMM yyyy"), F.concat(month, F.lit("-x"))))
    names = o.select(folder.alias("folder")).distinct()
    match = lambda pattern, manual: paths.folder_matches(F.col("folder"), pattern, manual)
    return names.select("folder", match(FOLDER_PATTERNS["YYYY-MM"], []).alias("by_month"), match(FOLDER_PATTERNS["Month YYYY"], []).alias("by_name"), match(None, ["1995-03-x"]).alias("by_hand"))


@query(
    "SELECT doc_id, CASE WHEN r = 1 THEN name ELSE regexp_replace(name, '\\.png$', '') || ' (' || r || ')' || '.png' END AS name FROM (SELECT doc_id, source, lang || '.png' AS name, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents)"
)
def unique_names(spark, d):
    from pyspark.sql import Window

    docs = V.read(spark, d, "documents").select("doc_id", "source", F.concat(F.col("lang"), F.lit(".png")).alias("name"))
    n = F.row_number().over(Window.partitionBy("source", "name").orderBy("doc_id"))
    return docs.withColumn("n", n).select("doc_id", paths.numbered_name(F.col("name"), F.col("n")).alias("name"))


@query("SELECT starts_with(url, 'https://') AS inside, count(*) AS n FROM pages GROUP BY 1")
def import_partition(spark, d):
    inside, outside = edits.outside_root(V.read(spark, d, "pages").select(F.col("url").alias("path")), "https:/")
    return inside.select(F.lit(True).alias("inside")).unionAll(outside.select(F.lit(False))).groupBy("inside").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, greatest(0, epoch_us(ts) // 1000) AS ms FROM events")
def iso_time(spark, d):
    ts = F.col("ts").cast("timestamp")
    return V.read(spark, d, "events").select("event_id", numbers.iso_time(ts).alias("iso"), numbers.epoch_ms(ts).alias("ms"))


@query("SELECT DISTINCT 'Imported ' || strftime(o_orderdate, '%m-%Y') AS folder FROM orders")
def import_folder(spark, d):
    return V.read(spark, d, "orders").select(paths.import_folder(F.col("o_orderdate")).alias("folder")).distinct()


# --- functions ----------------------------------------------------------------------------------


@query("SELECT doc_id, base64(encode(text)) AS b64 FROM documents")
def base64_text(spark, d):
    return V.read(spark, d, "documents").select("doc_id", text.base64_text(F.col("text").cast("binary")).alias("b64"))


@query("SELECT event_id, content FROM (SELECT event_id, nullif(trim(json_extract_string(r, '$.choices[0].message.content')), '') AS content FROM (SELECT event_id, '{\"choices\":[{\"message\":{\"content\":\" ' || event_type || ' \"}}]}' AS r FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, props FROM events WHERE event_id % 3 = 0))")
def describe_parse(spark, d):
    e = V.read(spark, d, "events")
    response = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit('{"choices":[{"message":{"content":" '), F.col("event_type"), F.lit(' "}}]}')))
    return e.select("event_id", text.describe_content(response).alias("content"))


SIZES_SQL = "sizes AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * (1 + o_orderkey % 97) AS b FROM orders)"


@query(
    """SELECT o_orderkey, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B'
  WHEN b < 1048576 THEN CASE WHEN b / 1024.0 >= 10 THEN CAST(floor(CAST(b AS DOUBLE) / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f KB', floor(CAST(b AS DOUBLE) / 1024 * 10 + 0.5) / 10) END
  WHEN b < 1073741824 THEN CASE WHEN b / 1048576.0 >= 10 THEN CAST(floor(CAST(b AS DOUBLE) / 1048576 + 0.5) AS BIGINT) || ' MB' ELSE printf('%.1f MB', floor(CAST(b AS DOUBLE) / 1048576 * 10 + 0.5) / 10) END
  ELSE CASE WHEN b / 1073741824.0 >= 10 THEN CAST(floor(CAST(b AS DOUBLE) / 1073741824 + 0.5) AS BIGINT) || ' GB' ELSE printf('%.1f GB', floor(CAST(b AS DOUBLE) / 1073741824 * 10 + 0.5) / 10) END END AS size FROM sizes""",
    (SIZES_SQL,),
)
def format_bytes(spark, d):
    k = F.col("o_orderkey").cast("long")
    return V.read(spark, d, "orders").select("o_orderkey", text.format_bytes(k * k * (1 + k % 97)).alias("size"))


BOX_SQL = """boxes AS (SELECT doc_id, 1 + doc_id * 37 % 4000 AS w, 1 + doc_id * 101 % 3000 AS h FROM documents),
scaled AS (SELECT *, least(CAST(CAST(320 AS DOUBLE) / w AS FLOAT), CAST(CAST(320 AS DOUBLE) / h AS FLOAT)) AS s FROM boxes),
fitted AS (SELECT *, greatest(1, CAST(floor(CAST(w AS FLOAT) * s) AS INTEGER)) AS new_w, greatest(1, CAST(floor(CAST(h AS FLOAT) * s) AS INTEGER)) AS new_h FROM scaled)"""


@query("SELECT doc_id, new_w, new_h, CAST((320 - new_w) // 2 AS INTEGER) AS pad_x, CAST((320 - new_h) // 2 AS INTEGER) AS pad_y FROM fitted", (BOX_SQL,))
def letterbox_geometry(spark, d):
    doc = F.col("doc_id")
    boxes = V.read(spark, d, "documents").select("doc_id", numbers.letterbox(1 + doc * 37 % 4000, 1 + doc * 101 % 3000).alias("b"))
    return boxes.select("doc_id", "b.*")


@query(
    """SELECT hash, CASE WHEN nsfw_score IS NULL THEN 'NudeNet: not analyzed' ELSE 'NudeNet: ' || CASE WHEN nsfw_score >= CAST(0.45 AS FLOAT) THEN 'Explicit' ELSE 'Below explicit threshold' END || ' (' || CAST(floor(CAST(nsfw_score AS DOUBLE) * 100 + 0.5) AS BIGINT) || '%; threshold 45%)' || ' / ' || array_to_string(nsfw_labels, ' · ') END
  || ' / ' || CASE WHEN ocr_word_count IS NULL THEN 'Text: not analyzed' ELSE 'Text: ' || ocr_word_count || ' words · ' || CAST(floor(CAST(ocr_text_area_ratio AS DOUBLE) * 100 + 0.5) AS BIGINT) || '% area' END
  || CASE WHEN ocr_text_chars > 0 THEN ' / Extracted text: ' || ocr_text_chars || ' chars saved' WHEN ocr_text_chars IS NOT NULL THEN ' / Extracted text: no text found' ELSE '' END
  || CASE WHEN video_title <> '' THEN ' / Video: ' || video_title ELSE '' END
  || CASE WHEN vision_desc_chars > 0 THEN ' / Description: ' || vision_desc_chars || ' chars saved' ELSE '' END
  || CASE WHEN classified_by IS NOT NULL THEN ' / Classification: ' || category || ' (' || classified_by || ')' ELSE '' END AS summary FROM records""",
    (V.RECORDS_SQL,),
)
def analysis_summary(spark, d):
    return V.records(spark, d).select("hash", F.array_join(text.analysis_summary(), " / ").alias("summary"))


# --- edits --------------------------------------------------------------------------------------

CHANGES_SQL = """changes AS (SELECT coalesce(r.hash, 'new' || e.user_id) AS hash, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS category, event_id FROM events e LEFT JOIN records r ON r.modified_ms = e.user_id * 1000),
latest AS (SELECT hash, arg_max(struct_pack(c := category), event_id).c AS category FROM changes GROUP BY hash)"""


@query(
    f"""SELECT coalesce(r.hash, c.hash) AS hash, CASE WHEN c.hash IS NULL THEN r.category ELSE c.category END AS category,
  CASE WHEN c.hash IS NULL THEN r.classified_by WHEN c.category IS NOT NULL THEN 'manual' END AS classified_by,
  CASE WHEN c.hash IS NULL THEN r.classified_at WHEN c.category IS NOT NULL THEN '{NOW}' END AS classified_at FROM records r FULL JOIN latest c ON r.hash = c.hash""",
    (V.RECORDS_SQL, CHANGES_SQL),
)
def assign_last_wins(spark, d):
    records = V.records(spark, d)
    e = V.read(spark, d, "events").withColumn("modified_ms", F.col("user_id") * 1000)
    changes = e.join(records.select("modified_ms", "hash"), "modified_ms", "left")
    changes = changes.select(F.coalesce("hash", F.concat(F.lit("new"), F.col("user_id").cast("string"))).alias("hash"), F.nullif("event_type", F.lit("view")).alias("category"), F.col("event_id").alias("at"))
    return edits.assign(records, changes, F.lit(NOW)).select(*STATE_COLUMNS)


@query("SELECT hash, CASE WHEN category = 'Cat1' THEN 'Holiday' ELSE category END AS category, classified_by FROM records", (V.RECORDS_SQL,))
def rename_category(spark, d):
    return edits.rename_category(V.records(spark, d), "Cat1", "Holiday").select("hash", "category", "classified_by")


@query("SELECT hash, CASE WHEN category <> 'High Text' THEN category END AS category, CASE WHEN category IS DISTINCT FROM 'High Text' THEN classified_by END AS classified_by, classified_at FROM records", (V.RECORDS_SQL,))
def delete_category(spark, d):
    return edits.delete_category(V.records(spark, d), "High Text").select(*STATE_COLUMNS)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN source IN ('src1', 'src7') THEN 'src1,src7' ELSE 'src1,src7,' || source END ELSE CASE source WHEN 'src1' THEN 'src7' WHEN 'src7' THEN 'src1' ELSE 'src1,src7' END END AS excluded FROM documents")
def toggle_folder(spark, d):
    base = F.array(*[F.lit(x) for x in V.EXCLUDED])
    return V.read(spark, d, "documents").select("doc_id", F.array_join(edits.toggled(base, F.col("source"), F.col("doc_id") % 2 == 0), ",").alias("excluded"))


# --- modes that agree with old libraries (no SQL; tested against the plain functions) ------------


@query()
def legacy_content_hash(spark, d):
    """Each document's text as a file's content."""
    docs = V.read(spark, d, "documents")
    head = F.substring(F.col("text").cast("binary"), 1, 65536)
    return docs.select("doc_id", legacy.content_hash_column(F.octet_length("text"), head).alias("hash"))


@query()
def legacy_sample(spark, d):
    """The title plan with samples as old libraries drew them."""
    return _title_plan(spark, d).select("key", "member_hashes", legacy.sample_column(F.col("member_hashes"), 10).alias("selected_hashes"))


@query("SELECT hash, relative_path, last_known_path = relative_path AS is_winner FROM files f JOIN (SELECT hash, last_known_path FROM records) USING (hash) WHERE last_known_path <> relative_path OR last_known_path = relative_path", (V.FILES_SQL, V.RECORDS_SQL))
def duplicate_files(spark, d):
    """Every file with whether its record points at it: copies share a record."""
    joined = V.files(spark, d).join(V.records(spark, d).select("hash", "last_known_path"), "hash")
    return joined.select("hash", "relative_path", (F.col("last_known_path") == F.col("relative_path")).alias("is_winner"))


@query("SELECT l.hash, l.relative_path, CASE WHEN r.hash IS NOT NULL THEN '.thumbs/' || l.hash || '.jpg' END AS thumbnail FROM files l LEFT JOIN (SELECT hash FROM records WHERE modified_ms % 2000 = 0) r ON l.hash = r.hash", (V.FILES_SQL, V.RECORDS_SQL))
def thumbnails_joined(spark, d):
    made = V.records(spark, d).where("modified_ms % 2000 = 0").select("hash", F.concat(F.lit(".thumbs/"), F.col("hash"), F.lit(".jpg")).alias("thumbnail"))
    return shown.with_thumbnails(V.files(spark, d).select("hash", "relative_path"), made)


@query("SELECT p_partkey, round_even(CAST(CAST(greatest(0.0, least(1.0, p_retailprice / 1500)) AS FLOAT) AS DOUBLE), 6) AS share, CAST(greatest(96, least(280, p_size * 10)) AS INTEGER) AS tile FROM part")
def clamps(spark, d):
    part = V.read(spark, d, "part")
    share = numbers.unit((F.col("p_retailprice") / 1500).cast("float"))
    tile = F.greatest(F.lit(96), F.least(F.lit(280), F.col("p_size") * 10)).cast("int")
    return part.select("p_partkey", F.bround(share.cast("double"), 6).alias("share"), tile.alias("tile"))
