"""Text expressions: titles, keys, labels and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import VIDEO_MARKERS

SPACES = r"\p{IsWhite_Space}+"


def collapse_spaces(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_title(raw: Column) -> Column:
    """What stands before the first marker, in order of priority, that occurs at all; null without one or if nothing stands there."""
    cut = F.lit(None).cast("string")
    for marker in reversed(VIDEO_MARKERS):
        quoted = re.escape(marker)
        cut = F.when(raw.rlike(f"(?i){quoted}"), F.regexp_extract(raw, f"(?is)^(.*?){quoted}", 1)).otherwise(cut)
    return F.nullif(collapse_spaces(cut), F.lit(""))


def group_key(title: Column) -> Column:
    """Letters and digits in lower case, anything between them as one space."""
    return F.trim(F.lower(F.regexp_replace(title, r"[^\p{IsAlphabetic}\p{N}]+", " ")))


def base64_text(data: Column) -> Column:
    """Padded base64 on one line, whatever the session says about line breaks."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def char_count(text: Column) -> Column:
    """Unicode code points."""
    return F.length(text)


def percent(value: Column) -> Column:
    """A share as a whole percentage, halves upwards; null for null and NaN."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.format_string("%d%%", F.floor(value.cast("double") * 100 + 0.5)))


def label_percent(score: Column) -> Column:
    """A float score as a whole percentage, exact halves to even."""
    return F.format_string("%d%%", F.bround((score * F.lit(100.0).cast("float")).cast("double"), 0).cast("long"))


def format_bytes(size: Column) -> Column:
    """``0 B``, ``999 B``, ``1.5 KB``, ``12 MB``: one decimal below 10, none above or for bytes; GB is the largest unit."""
    size = size.cast("double")
    out = F.lit("0 B")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        value = size / float(1024**power)
        # toFixed rounds halves of the exact binary value up
        one = F.format_string("%.1f " + unit, F.floor(value * 10 + 0.5) / 10)
        whole = F.format_string("%d " + unit, F.floor(value + 0.5))
        step = F.when(value >= 10, whole).otherwise(one)
        out = step if power == 3 else F.when(size >= float(1024 ** (power + 1)), out).otherwise(step)
    bytes_ = F.format_string("%d B", size.cast("long"))
    return F.when(size.isNull() | (size == 0), F.lit("0 B")).when(size < 1024, bytes_).otherwise(out)


def counted(n: Column, noun: str) -> Column:
    """``1 image``, ``2 images``."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def natural_key(name: Column) -> Column:
    """Sorts like numeric, case- and accent-insensitive comparison: digit runs by value, of any length."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    value = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    # A longer run of digits is the larger number; ten digits hold the length of any string.
    padded = F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(value(x)).cast("string"), 10, "0"), value(x))).otherwise(x))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def matches_search(name: Column, path: Column, query: str) -> Column:
    """Whether the trimmed, lower-cased query is part of the lower-cased name and path; a blank one always is."""
    query = query.strip().lower()
    return F.lower(F.concat_ws(" ", name, path)).contains(query) if query else F.lit(True)


def describe_content(response: Column) -> Column:
    """The trimmed text of a chat completion, null if it has none."""
    text = F.get_json_object(response, "$.choices[0].message.content")
    return F.nullif(F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""), F.lit(""))


def preview(text: Column, chars: int = 240) -> Column:
    return F.substring(text, 1, chars)


def folder_summary(done: int, total: int, cancelled: bool) -> str:
    """The closing line of a scheduled refresh."""
    if cancelled:
        return f"Cancelled after {done} of {total} folder{'' if total == 1 else 's'}."
    return f"Completed {done} folder{'' if done == 1 else 's'}."


def skip_notes(unscored: int, explicit: int, video: int) -> str:
    """The message of a description pass that found nothing to do."""
    # The wording is part of the result.
    notes = [f"{n} {what}" for n, what in ((unscored, "not yet Explicit-analyzed (run Explicit first)"), (explicit, "explicit"), (video, "deduped video frames")) if n]
    return f"Nothing to describe. Skipped: {', '.join(notes)}." if notes else "No images needed description."


def described_summary(described: int, failures: int, endpoint: str) -> str:
    text = f"Described {described} image{'' if described == 1 else 's'}."
    return text + (f" {failures} failed (see logs; endpoint {endpoint})." if failures else "")


def short_path(path: Column) -> Column:
    """A path of over three parts as its first and last two, with backslashes."""
    normal = F.replace(path, F.lit("/"), F.lit("\\"))
    parts = F.filter(F.split(normal, r"\\"), lambda x: x != "")
    short = F.concat(F.element_at(parts, 1), F.lit("\\...\\"), F.array_join(F.slice(parts, -2, 2), "\\"))
    return F.when(path.isNull() | (path == ""), "").when(F.size(parts) <= 3, normal).otherwise(short)


def date_label(ms: Column) -> Column:
    """``Jan 2, 03:04 PM`` in UTC; ``Unknown date`` for null and 0."""
    return F.when(ms.isNull() | (ms == 0), "Unknown date").otherwise(F.date_format(F.timestamp_millis(ms), "MMM d, hh:mm a"))


def analysis_summary(threshold: float = 0.45) -> Column:
    """The lines that sum up a view row's analysis."""
    # The wording of the lines is the result.
    c, line = F.col, F.concat
    score, limit = c("nsfw_score"), F.lit(threshold).cast("float")
    status = F.when(score >= limit, "Explicit").otherwise("Below explicit threshold")
    labels = F.when(F.coalesce(F.size("nsfw_labels"), F.lit(0)) > 0, F.array_join("nsfw_labels", " · ")).otherwise("No NudeNet labels recorded")
    scored = score.isNotNull()
    text = c("ocr_word_count").isNotNull() & c("ocr_text_area_ratio").isNotNull()
    return F.array_compact(
        F.array(
            F.when(scored, line(F.lit("NudeNet: "), status, F.lit(" ("), percent(score), F.lit("; threshold "), percent(limit), F.lit(")"))).otherwise("NudeNet: not analyzed"),
            F.when(scored, labels),
            F.when(text, line(F.lit("Text: "), c("ocr_word_count").cast("string"), F.lit(" words · "), percent(c("ocr_text_area_ratio")), F.lit(" area"))).otherwise("Text: not analyzed"),
            F.when(c("ocr_text_chars") > 0, line(F.lit("Extracted text: "), c("ocr_text_chars").cast("string"), F.lit(" chars saved"))).when(c("ocr_text_chars").isNotNull(), "Extracted text: no text found"),
            F.when(F.length("video_title") > 0, line(F.lit("Video: "), c("video_title"))),
            F.when(c("vision_desc_chars") > 0, line(F.lit("Description: "), c("vision_desc_chars").cast("string"), F.lit(" chars saved"))).when(c("vision_desc_chars").isNotNull(), "Description: empty"),
            F.when(F.length("classified_by") > 0, line(F.lit("Classification: "), F.coalesce(F.nullif(c("category"), F.lit("")), F.lit("Unclassified")), F.lit(" ("), c("classified_by"), F.lit(")"))),
        )
    )
