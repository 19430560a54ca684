"""The stored documents of a library as configuration and tables."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AREA_THRESHOLD, SCORE_THRESHOLD, WORD_THRESHOLD, Names
from ..functions.numbers import tile_size
from ..functions.paths import check_time
from ..operators.edits import move_to_front
from ..operators.passes import SCHEDULED
from ..schema import PLAN, PLAN_DOCUMENT, RECORD_COLUMNS, RECORDS, STATE_DOCUMENT, camel, struct


@dataclass(frozen=True)
class Config:
    """What a library remembers beside its records; a threshold that was never set has its default."""

    version: int = 1
    source_pattern_preset: str | None = None
    source_pattern_regex: str | None = None
    manual_source_folders: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    excluded_analysis_folders: tuple[str, ...] = ()
    ocr_word_threshold: int = WORD_THRESHOLD
    ocr_area_threshold: float = AREA_THRESHOLD
    nsfw_score_threshold: float = SCORE_THRESHOLD

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    def to_json(self) -> dict:
        return {camel(k): list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v is not None}

    @staticmethod
    def from_json(found: dict) -> Config:
        known = {k: found[camel(k)] for k in asdict(Config()) if found.get(camel(k)) is not None}
        return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


#: Fixed value: the edge of a tile that was never set.
DEFAULT_TILE_SIZE = 168


@dataclass(frozen=True)
class Settings:
    """Engine settings that aren't a library's: where descriptions come from and what a scheduled refresh does."""

    vision_endpoint: str = ""
    vision_model: str = ""
    known_roots: tuple[str, ...] = ()
    auto_refresh_enabled: bool = False
    auto_refresh_time: str = "04:00"
    auto_refresh_roots: tuple[str, ...] = ()
    auto_refresh_passes: tuple[str, ...] = ()
    last_auto_refresh_summary: str | None = None
    tile_size: int = DEFAULT_TILE_SIZE
    dark_mode: bool = True
    extra: dict = field(default_factory=dict)


def read_settings(path: str) -> Settings:
    """The settings file; defaults if there is none, ValueError if it can't be read."""
    if not os.path.exists(path):
        return Settings()
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except ValueError as error:
        raise ValueError(f"{path} is no settings document") from error
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in Settings.__dataclass_fields__}
    return Settings(**known)


def write_settings(settings: Settings, path: str) -> None:
    """Replaces the settings file by a whole one."""
    fresh = f"{path}.tmp"
    with open(fresh, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2)
    os.replace(fresh, path)


def remember_root(settings: Settings, root: str) -> Settings:
    """The root first among the known ones, each once."""
    return replace(settings, known_roots=tuple(move_to_front(list(settings.known_roots), root)))


def with_vision(settings: Settings, endpoint: str, model: str) -> Settings:
    """Where descriptions come from; blank ones stand for the defaults."""
    return replace(settings, vision_endpoint=endpoint.strip(), vision_model=model.strip())


def with_tile_size(settings: Settings, size: int) -> Settings:
    return replace(settings, tile_size=tile_size(size))


def with_dark_mode(settings: Settings, on: bool) -> Settings:
    return replace(settings, dark_mode=bool(on))


def choose_root(settings: Settings, root: str) -> Settings:
    """Checks a root that a user chose and remembers it first."""
    if not os.path.isdir(root):
        raise ValueError(f"{root} is no folder")
    return remember_root(settings, os.path.abspath(root))


def with_auto_refresh(settings: Settings, enabled: bool, at: str, roots: list[str], passes: list[str]) -> Settings:
    """Checked settings of the scheduled refresh: known roots that exist, at a time of day."""
    known = tuple(r for r in roots if r in settings.known_roots and os.path.isdir(r))
    if enabled and not known:
        raise ValueError("Choose at least one folder to refresh.")
    return replace(settings, auto_refresh_enabled=enabled, auto_refresh_time=check_time(at), auto_refresh_roots=known, auto_refresh_passes=tuple(p for p in SCHEDULED if p in passes))


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one row of a JSON document.  Its name may begin with a dot, which Spark's own readers pass over."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        if not isinstance(json.loads(text), dict):
            raise ValueError
    except ValueError as error:
        raise ValueError(f"{path} is no such document") from error
    return spark.createDataFrame([(text,)], "value string").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def read_state(spark: SparkSession, path: str) -> tuple[Config, DataFrame]:
    """(config, records) of a state document; ValueError on a corrupt one, which is never taken for an empty library."""
    document = _document(spark, path, STATE_DOCUMENT)
    rows = document.select(F.explode("images").alias("hash", "r"))
    records = rows.select("hash", *[F.col(f"r.{camel(c)}").alias(c) for c in RECORD_COLUMNS])
    return Config.from_json(document.drop("images").first().asDict()), records


def read_library_state(spark: SparkSession, root: str, names: Names = Names()) -> tuple[Config, DataFrame]:
    """The state in a library's root; an empty one if it has none yet."""
    path = f"{root.rstrip('/')}/{names.state}"
    if not os.path.exists(path):
        return Config(), spark.createDataFrame([], struct(RECORDS))
    return read_state(spark, path)


def read_plan(spark: SparkSession, path: str) -> DataFrame | None:
    """(title, member_hashes, selected_hashes) of a plan document, None without the file."""
    if not os.path.exists(path):
        return None
    groups = _document(spark, path, PLAN_DOCUMENT).select(F.explode("groups").alias("g"))
    return groups.select(F.col("g.title").alias("title"), F.col("g.memberHashes").alias("member_hashes"), F.col("g.selectedHashes").alias("selected_hashes"))


def plan_path(root: str, names: Names = Names()) -> str:
    return f"{root.rstrip('/')}/{names.plan}"


def no_plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct(PLAN))
