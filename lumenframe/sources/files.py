"""Files as rows: folder discovery, depth-limited walks, store listings and content hashes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HASH_BYTES, IMAGE_EXTENSIONS, MAX_IMPORT_DEPTH, MAX_SCAN_DEPTH, ROOT
from ..functions.paths import check_pattern, extension, file_name, is_image, slashes
from ..functions.numbers import epoch_ms
from ..schema import FILES, struct
from .legacy import content_hash

SCANNED = "relative_path string, absolute_path string, name string, source_folder string, is_root boolean, size bigint, modified_ms bigint"


#: Rows of a flat folder that a task hands on at a time.
SCAN_ROWS = 5000


def is_image_name(name: str) -> bool:
    head, dot, ext = name.rpartition(".")
    return bool(head and dot) and ext.lower() in IMAGE_EXTENSIONS


def discover_folders(spark: SparkSession, root: str, pattern: str | None, manual: list[str]) -> list[tuple[str, bool]]:
    """(name, listed by hand) of the root's direct folders that are sources, by lower-case name.

    Folders only: their number is that of one directory level, which the driver lists anyway.
    """
    from ..functions.paths import folder_matches

    names = [e.name for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".")]
    check_pattern(pattern)
    if not names:
        return []
    rows = spark.createDataFrame([(n,) for n in names], "name string").where(folder_matches(F.col("name"), pattern, manual))
    return sorted(((r.name, r.name in manual) for r in rows.collect()), key=lambda x: (x[0].lower(), x[0]))


def _walk(folder: str, depth: int, most: int) -> Iterator[os.DirEntry]:
    """Files below a folder, names with a leading dot skipped, ``most`` levels deep; what can't be read is skipped."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.name.startswith("."):
            continue
        if e.is_dir():
            if depth < most:
                yield from _walk(e.path, depth + 1, most)
        elif e.is_file() and is_image_name(e.name):
            yield e


def scan(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Image files of the root itself and, MAX_SCAN_DEPTH levels deep, of its source folders; no content is read.

    Tasks list the source folders, and each direct child is walked as a task of its own.  The root must
    be mounted on all executors; ``scan_store`` lists any other store.
    """
    base = os.path.abspath(root)
    columns = ["start", "folder", "is_root", "depth"]
    starts = "start string, folder string, is_root boolean, depth int"

    def children(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["folder"]:
                below = [e.name for e in os.scandir(f"{base}/{folder}") if e.is_dir() and not e.name.startswith(".")]
                yield pd.DataFrame([(folder, folder, False, 0), *((f"{folder}/{n}", folder, False, 1) for n in below)], columns=columns)

    tasks = spark.createDataFrame([("", ROOT, True, -1)], starts)
    if folders:
        listed = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), spark.sparkContext.defaultParallelism * 4))
        tasks = tasks.unionByName(listed.mapInPandas(children, starts))
    tasks = tasks.repartition(spark.sparkContext.defaultParallelism * 4)
    named = ["relative_path", "absolute_path", "name", "source_folder", "is_root", "size", "modified_ms"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, folder, at_root, depth in frame.itertuples(index=False):
                # A folder's own level and the root's are listed alone: deeper levels are other tasks.
                flat = depth <= 0
                found = _walk(f"{base}/{start}" if start else base, 0 if flat else depth, 0 if flat else MAX_SCAN_DEPTH)
                rows = []
                for e in found:
                    stat = e.stat()
                    path = os.path.relpath(e.path, base).replace("\\", "/")
                    rows.append((path, e.path, e.name, folder, at_root, stat.st_size, max(0, stat.st_mtime_ns // 1_000_000)))
                    if len(rows) == SCAN_ROWS:
                        yield pd.DataFrame(rows, columns=named)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=named)

    return tasks.mapInPandas(run, SCANNED)


def scan_store(spark: SparkSession, root_uri: str) -> DataFrame:
    """The same columns of a store that only Spark lists; Spark skips names with a leading underscore too."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root_uri).select("path", "length", "modificationTime")
    base = root_uri.split("://", 1)[-1].rstrip("/")
    rel = slashes(F.substring(F.col("path"), F.instr("path", F.lit(base + "/")) + len(base) + 1, F.length("path")))
    from ..functions.paths import depth_below_folder, hidden, source_folder

    rows = listed.withColumn("relative_path", rel).where(~hidden(F.col("relative_path")) & (depth_below_folder(F.col("relative_path")) <= MAX_SCAN_DEPTH))
    name = file_name(F.col("relative_path"))
    rows = rows.where(is_image(name) & (extension(name) != ""))
    return rows.select("relative_path", F.col("path").alias("absolute_path"), name.alias("name"), source_folder(F.col("relative_path")).alias("source_folder"), (F.instr("relative_path", "/") == 0).alias("is_root"), F.col("length").alias("size"), epoch_ms(F.col("modificationTime")).alias("modified_ms"))


def prefix_hash(path: str, size: int, legacy: bool = False) -> str | None:
    """A hash of a file's size and first 64 KiB; null if it can't be read."""
    try:
        with open(path, "rb") as f:
            head = f.read(HASH_BYTES)
    except OSError:
        return None
    return content_hash(size, head) if legacy else hashlib.md5(size.to_bytes(8, "little") + head).hexdigest()


def hash_files(files: DataFrame, legacy: bool = False) -> DataFrame:
    """``files`` with every null hash computed; the others' contents aren't opened.  Unreadable files go."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            todo = frame["hash"].isna()
            frame.loc[todo, "hash"] = [prefix_hash(p, int(n), legacy) for p, n in zip(frame.loc[todo, "absolute_path"], frame.loc[todo, "size"], strict=True)]
            yield frame

    known = files.where("hash is not null")
    missing = files.where("hash is null")
    hashed = missing.mapInPandas(run, missing.schema).where("hash is not null")
    return known.unionByName(hashed)


def import_sources(paths: list[str]) -> list[str]:
    """The images among dropped files and folders, MAX_IMPORT_DEPTH levels deep; a dropped file counts whatever its first letter."""
    out: list[str] = []
    for path in paths:
        if os.path.isfile(path):
            out += [path] if is_image_name(Path(path).name) else []
        elif os.path.isdir(path):
            out += [e.path for e in _walk(path, 1, MAX_IMPORT_DEPTH)]
    return out


def image_sizes(spark: SparkSession, uri: str) -> DataFrame:
    """(path, width, height) of the images that the JVM decodes; others are left out."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(uri).select(F.col("image.origin").alias("path"), "image.width", "image.height")


def no_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct(FILES))
