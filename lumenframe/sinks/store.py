"""Where records live: versioned Parquet with a pointer that is swapped, and exports of it."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DESCRIPTION_SCHEMA, PROMPT_VERSION, Names
from ..schema import RECORD_COLUMNS, RECORDS, camel, struct
from ..sources.documents import Config

_LOCKS: dict[str, threading.RLock] = {}


def lock(name: str) -> threading.RLock:
    """One lock a library on this driver: read, merge and write happen under it."""
    return _LOCKS.setdefault(name, threading.RLock())


class RecordStore:
    """Records and configuration of a library in a folder of any store that Spark writes to.

    A commit writes a new version next to the one it was read from and then a pointer to it, whose name
    has the next number; the largest number counts and older pointers go afterwards.  So readers see
    whole versions only, and a job that fails at any moment leaves the last one.  Of two drivers that
    commit at once the second finds its number taken and fails.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _numbers(self) -> list[int]:
        fs, path = self._fs(self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        found = sorted(int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-"))
        if not found and any(n.startswith("records-") for n in names):
            raise ValueError(f"{self.folder} has records but no pointer to them")
        return found

    def _pointer(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        fs, path = self._fs(f"{self.folder}/CURRENT-{numbers[-1]:012d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": numbers[-1]}
        finally:
            stream.close()

    def _point(self, value: dict) -> None:
        """Publishes the pointer that follows ``value['number']``, and removes those before it."""
        number = value.get("number", 0) + 1
        fs, path = self._fs(f"{self.folder}/CURRENT-{number:012d}")
        _, fresh = self._fs(f"{self.folder}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps({k: v for k, v in value.items() if k != "number"}).encode()))
        finally:
            out.close()
        if fs.exists(path) or not fs.rename(fresh, path):
            fs.delete(fresh, False)
            raise RuntimeError(f"{self.folder} was changed by another driver")
        for old in self._numbers():
            if old < number:
                self.remove(f"{self.folder}/CURRENT-{old:012d}")

    def read(self) -> tuple[Config, DataFrame]:
        found = self._pointer()
        if found is None or "version" not in found:
            return Config(), self.spark.createDataFrame([], struct(RECORDS))
        return Config.from_json(found["config"]), self.spark.read.schema(RECORDS).parquet(f"{self.folder}/{found['version']}")

    def commit(self, change: Callable[[Config, DataFrame], tuple[Config, DataFrame]]) -> tuple[Config, DataFrame]:
        """Applies a change to what is stored now, writes it and returns it as written."""
        with lock(self.folder):
            if self._pointer() is None:
                self._point({"past": []})  # before any records, so that records without a pointer are an error
            before = self._pointer()
            config, records = change(*self.read())
            version = f"records-{uuid.uuid4().hex}"
            records.select("hash", *RECORD_COLUMNS).write.parquet(f"{self.folder}/{version}")
            past = [*before.get("past", []), *([before["version"]] if "version" in before else [])]
            self._point({"number": before["number"], "version": version, "config": config.to_json(), "past": past[-self.keep :]})
            for old in past[: -self.keep]:
                self.remove(f"{self.folder}/{old}")
            return self.read()

    def remove(self, path: str) -> None:
        """Deletes a table that nothing reads any more."""
        fs, hadoop = self._fs(path)
        fs.delete(hadoop, True)

    def configure(self, change: Callable[[Config], Config]) -> Config:
        """Changes the configuration alone; no records are rewritten."""
        with lock(self.folder):
            found = self._pointer()
            if found is None or "version" not in found:
                return self.commit(lambda c, r: (change(c), r))[0]
            config = change(Config.from_json(found["config"]))
            self._point({**found, "config": config.to_json()})
            return config


def _replace(path: str, write: Callable) -> None:
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(fresh, "w", encoding="utf-8") as f:
        write(f)
    os.replace(fresh, path)


def export_state(config: Config, records: DataFrame, path: str) -> None:
    """One state document, its records streamed through the driver; null fields are left out."""
    fields = F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in RECORD_COLUMNS]))

    def write(f) -> None:
        f.write(json.dumps(config.to_json())[:-1] + ', "images": {')
        for i, r in enumerate(records.select("hash", fields.alias("j")).toLocalIterator()):
            f.write((",\n" if i else "\n") + json.dumps(r.hash) + ": " + r.j)
        f.write("\n}}")

    _replace(path, write)


def export_plan(plan: DataFrame, path: str, samples: int, now: str) -> None:
    """One plan document, its groups in order."""
    group = F.to_json(F.struct("title", F.col("member_hashes").alias("memberHashes"), F.col("selected_hashes").alias("selectedHashes")))

    def write(f) -> None:
        f.write(json.dumps({"version": 1, "generatedAt": now, "samplesPerGroup": samples})[:-1] + ', "groups": [')
        for i, r in enumerate(plan.select(group.alias("j")).toLocalIterator()):
            f.write((",\n" if i else "\n") + r.j)
        f.write("\n]}")

    _replace(path, write)


def export_index(index: DataFrame, path: str, now: str, names: Names = Names()) -> None:
    """One document that maps relative paths to hashes."""

    def write(f) -> None:
        f.write(json.dumps({"version": 1, "generatedAt": now, "descriptionDir": names.descriptions})[:-1] + ', "byPath": {')
        for i, r in enumerate(index.toLocalIterator()):
            f.write((",\n" if i else "\n") + json.dumps(r.relative_path) + ": " + json.dumps(r.hash))
        f.write("\n}}")

    _replace(path, write)


def write_texts(texts: DataFrame, root: str, names: Names = Names()) -> None:
    """A file ``<hash>.txt`` a row of (hash, text); each hash is written by one task, under a temporary name first."""
    target = f"{root.rstrip('/')}/{names.texts}"
    os.makedirs(target, exist_ok=True)

    def run(rows) -> None:
        for r in rows:
            _replace(f"{target}/{r.hash}.txt", lambda f, r=r: f.write(r.text or ""))

    texts.select("hash", "text").dropDuplicates(["hash"]).foreachPartition(run)


def description_documents(described: DataFrame, model: str, now: str) -> DataFrame:
    """(hash, json, description, vision_desc_chars) of ``described(hash, relative_path, name, video_title, description)``."""
    document = F.struct(F.lit(DESCRIPTION_SCHEMA).alias("schemaVersion"), "hash", F.col("relative_path").alias("relativePath"), "name", F.nullif("video_title", F.lit("")).alias("videoTitle"), "description", F.lit(model).alias("model"), F.lit(PROMPT_VERSION).alias("promptVersion"), F.lit(now).alias("analyzedAt"))
    return described.select("hash", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"), "description", F.length("description").cast("int").alias("vision_desc_chars"))


def write_descriptions(documents: DataFrame, root: str, names: Names = Names()) -> None:
    """``<hash>.json`` and ``<hash>.txt`` of each description."""
    target = f"{root.rstrip('/')}/{names.descriptions}"
    os.makedirs(target, exist_ok=True)

    def run(rows) -> None:
        for r in rows:
            _replace(f"{target}/{r.hash}.json", lambda f, r=r: f.write(r.json))
            _replace(f"{target}/{r.hash}.txt", lambda f, r=r: f.write(r.description))

    documents.dropDuplicates(["hash"]).foreachPartition(run)


def write_thumbnails(files: DataFrame, root: str, shrink: Callable[[str, str], None], names: Names = Names()) -> DataFrame:
    """(hash, thumbnail): ``shrink(source, target)`` once a hash without a file yet; null where it fails."""
    target = f"{root.rstrip('/')}/{names.thumbnails}"
    os.makedirs(target, exist_ok=True)

    def run(frames):
        for frame in frames:
            out = []
            for h, path in zip(frame["hash"], frame["absolute_path"], strict=True):
                place, fresh = f"{target}/{h}.jpg", f"{target}/.{uuid.uuid4().hex}.jpg"
                if not os.path.exists(place):
                    try:
                        shrink(path, fresh)
                        os.replace(fresh, place)
                    except Exception:  # noqa: BLE001  an image without a thumbnail is still an image
                        place = None
                out.append(place)
            yield frame[["hash"]].assign(thumbnail=out)

    once = files.groupBy("hash").agg(F.max("absolute_path").alias("absolute_path"))
    return once.mapInPandas(run, "hash string, thumbnail string")
