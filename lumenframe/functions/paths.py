"""Path, name and folder expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FOLDER_PATTERNS, IMAGE_EXTENSIONS, MAX_SCAN_DEPTH, ROOT


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_folder(path: Column) -> Column:
    """What stands before the first slash, ``Root`` for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(ROOT)


def extension(name: Column) -> Column:
    """What follows the last dot; empty without one, and for a name that only begins with a dot."""
    return F.regexp_extract(name, r"(?s)^.+\.([^./]*)\z", 1)


def stem(name: Column) -> Column:
    ext = extension(name)
    return F.when(name.rlike(r"(?s)^.+\.[^./]*\z"), F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1)).otherwise(name)


def is_image(name: Column) -> Column:
    """Whether the extension is one of an image, in ASCII case-insensitively."""
    return F.lower(extension(name)).isin(*IMAGE_EXTENSIONS)


def depth_below_folder(path: Column) -> Column:
    """Directories between a source folder and a file; -1 for a file of the root itself."""
    return F.size(F.split(path, "/")) - 2


def hidden(path: Column) -> Column:
    """Whether a part of the path begins with a dot."""
    return path.rlike(r"(^|/)\.")


def in_scan(path: Column) -> Column:
    """Whether a scan finds a relative path: an image, nothing hidden, deep enough but not too deep."""
    return is_image(file_name(path)) & ~hidden(path) & (depth_below_folder(path) <= MAX_SCAN_DEPTH)


def effective_pattern(preset: str | None, custom: str | None) -> str | None:
    """A custom pattern that isn't blank, else the preset's, else none."""
    return custom if custom and custom.strip() else FOLDER_PATTERNS.get(preset or "")


def check_pattern(pattern: str | None) -> str | None:
    """A pattern that neither engine reads differently; look-around and back-references are refused, as is what doesn't compile."""
    if pattern is not None:
        if re.search(r"\(\?(<?[=!])|\\[1-9]", pattern):
            raise ValueError(f"Invalid source pattern: {pattern}")
        try:
            re.compile(re.sub(r"^\^\(\?i\)", "(?i)^", pattern))
        except re.error as error:
            raise ValueError(f"Invalid source pattern: {error}") from error
    return pattern


def folder_matches(name: Column, pattern: str | None, manual: list[str]) -> Column:
    """Whether a folder is a source: found by the pattern anywhere in its name, or listed."""
    found = F.lit(False)
    if pattern:
        exact = re.sub(r"(?<!\\)\$$", r"\\z", pattern)  # the end is the very end, not before a line break
        found = name.rlike(exact)
    return (found | name.isin(*manual) if manual else found) & ~name.startswith(".")


def import_folder(day: Column) -> Column:
    return F.concat(F.lit("Imported "), F.date_format(day, "MM-yyyy"))


def numbered_name(name: Column, n: Column) -> Column:
    """``a.png`` for 1, ``a (2).png`` for 2 and so on."""
    ext = extension(name)
    tail = F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))
    return F.when(n == 1, name).otherwise(F.concat(stem(name), F.lit(" ("), n.cast("string"), F.lit(")"), tail))


def check_name(name: str, what: str = "Folder") -> str:
    """The trimmed name of a folder or category; ValueError if no file system would take it or no scan find it."""
    name = name.strip()
    if not name:
        raise ValueError(f"{what} name cannot be empty.")
    if name in (".", "..") or name.endswith(".") or re.search(r'[/\\:*?"<>|\x00-\x1f\x7f-\x9f]', name):
        raise ValueError(f"{what} name contains unsupported characters.")
    if what == "Folder" and name.startswith("."):
        raise ValueError("Folders that begin with a dot are never scanned.")
    return name


def check_time(text: str) -> str:
    """``HH:MM``, zero-padded; ValueError unless it is a time of day."""
    found = re.fullmatch(r"\+?(\d+):\+?(\d+)", text.strip())
    if not found or int(found[1]) > 23 or int(found[2]) > 59:
        raise ValueError("Time must be HH:MM in 24-hour format.")
    return f"{int(found[1]):02d}:{int(found[2]):02d}"
