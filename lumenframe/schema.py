"""Schemas of the library's tables and documents, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_RECORD = (
    ("last_known_path", "string"),
    ("category", "string"),
    ("classified_by", "string"),
    ("classified_at", "string"),
    ("ocr_word_count", "int"),
    ("ocr_text_area_ratio", "float"),
    ("ocr_text_chars", "int"),
    ("nsfw_score", "float"),
    ("nsfw_labels", "array<string>"),
    ("video_title", "string"),
    ("vision_desc_chars", "int"),
    ("size", "bigint"),
    ("modified_ms", "bigint"),
)
RECORD_COLUMNS = tuple(name for name, _ in _RECORD)
RECORDS = "hash string, " + ", ".join(f"{n} {t}" for n, t in _RECORD)
FILES = "relative_path string, absolute_path string, name string, source_folder string, size bigint, modified_ms bigint, hash string"
TITLED = "hash string, title string"
PLAN = "title string, member_hashes array<string>, selected_hashes array<string>"
OCR_RESULT = "hash string, width float, height float, lines array<struct<text:string,words:array<struct<y:float,width:float,height:float>>>>"
DETECTIONS = "hash string, anchor int, class int, score float"


def camel(name: str) -> str:
    """snake_case as the camelCase of the stored documents."""
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


STATE_DOCUMENT = ", ".join(
    [
        "version int",
        "sourcePatternPreset string",
        "sourcePatternRegex string",
        "manualSourceFolders array<string>",
        "categories array<string>",
        "images map<string, struct<" + ", ".join(f"{camel(n)}: {t}" for n, t in _RECORD) + ">>",
        "ocrWordThreshold int",
        "ocrAreaThreshold double",
        "nsfwScoreThreshold double",
        "excludedAnalysisFolders array<string>",
    ]
)
PLAN_DOCUMENT = "version int, generatedAt string, samplesPerGroup int, groups array<struct<title: string, memberHashes: array<string>, selectedHashes: array<string>>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
