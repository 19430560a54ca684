"""A media library on disk: scanning, enrichment passes, edits, video plans, imports and scheduled refreshes."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions import paths, text
from .operators import classify, edits, passes, reconcile, videos, views
from .sinks import store as sinks
from .sources import documents, files, models
from .sources.models import Enricher


def now_iso() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@dataclass
class LibraryView:
    """The answer to a scan: lazily evaluated tables and the small lists beside them."""

    root: str
    config: documents.Config
    images: DataFrame
    folders: DataFrame
    categories: DataFrame
    unclassified: DataFrame

    def search(self, kind: str = "all", category: str | None = None, query: str = "", sort: str = "newest") -> DataFrame:
        """What a client shows: included folders, one filter, a search, sorted."""
        excluded = self.folders.where("excluded").select("name")
        any_folders = not self.folders.isEmpty()
        inside = views.included(self.images, self.folders, excluded, any_folders)
        return views.filtered(inside, kind, category, query).orderBy(*views.order(sort))


@dataclass
class ImportReport:
    imported: int
    skipped: int
    target_folder: str
    errors: list[str] = field(default_factory=list)


class Busy(RuntimeError):
    """A pass of this kind is running for the library."""


#: (root, pass) of what runs on this driver, whichever object started it.
_RUNNING: set[tuple[str, str]] = set()
_CANCELLED: set[tuple[str, str]] = set()
#: Commits of one pass at most.
MOST_BATCHES = 64


class Library:
    """One library; ``root`` is mounted on all executors, ``state`` may be in any store (by default below the root)."""

    def __init__(self, spark: SparkSession, root: str, state: str | None = None, legacy_hash: bool = False, clock: Callable[[], str] = now_iso, names: C.Names = C.Names(), shrink: Callable[[str, str], None] | None = None, events: Callable[[str, dict], None] = lambda kind, what: None):
        """``shrink(source, target)`` makes a thumbnail; ``events(kind, what)`` hears of progress and of what finished."""
        if not os.path.isdir(root):
            raise ValueError(f"{root} is no folder")
        self.shrink, self.events = shrink, events
        self.spark, self.root, self.legacy, self.now, self.names = spark, os.path.abspath(root), legacy_hash, clock, names
        self._scans: list[str] = []
        self.store = sinks.RecordStore(spark, state or f"file://{self.root}/.lumenframe")

    # --- scanning ---

    def adopt(self) -> documents.Config:
        """Takes over the state document in the root; a corrupt one raises and changes nothing."""
        config, records = documents.read_library_state(self.spark, self.root, self.names)
        return self.store.commit(lambda c, r: (config, records))[0]

    def export(self) -> str:
        """Writes the state document and returns its path."""
        path = f"{self.root}/{self.names.state}"
        sinks.export_state(*self.store.read(), path)
        return path

    def _rules(self, config: documents.Config, records: DataFrame, rules=("score", "text")) -> DataFrame:
        return classify.classify(records, F.lit(self.now()), config.ocr_word_threshold, config.ocr_area_threshold, config.nsfw_score_threshold, rules)

    def _with_builtins(self, config: documents.Config, records: DataFrame) -> documents.Config:
        gate = classify.gates(records).first()
        return config.with_(categories=tuple(classify.ensure_categories(list(config.categories), gate.has_score, gate.has_text)))

    def scan(self) -> LibraryView:
        """Walks the source folders, reuses known hashes, reconciles, classifies, and shows the result."""
        config, records = self.store.read()
        pattern = paths.effective_pattern(config.source_pattern_preset, config.source_pattern_regex)
        folders = files.discover_folders(self.spark, self.root, pattern, list(config.manual_source_folders))
        names = [n for n, _ in folders]
        found = files.scan(self.spark, self.root, names)
        seen = files.hash_files(reconcile.reuse_hashes(found, reconcile.hash_index(records)), self.legacy)
        shared = f"{self.store.folder}/files-{self.now().replace(':', '')}"
        seen.write.mode("overwrite").parquet(f"{shared}/files")  # what was found is read once, however often it is used
        self._scans.append(shared)
        for old in self._scans[:-3]:  # views of the last scans stay readable
            self.store.remove(old)
        del self._scans[:-3]
        seen = self.spark.read.parquet(f"{shared}/files")
        if self.shrink:  # once a hash; those made before are only looked up
            sinks.write_thumbnails(seen, self.root, self.shrink, self.names).write.mode("overwrite").parquet(f"{shared}/thumbnails")

        def change(config, records):
            after = reconcile.reconcile(records, seen, names)
            config = self._with_builtins(config, after)
            after = classify.invalidate_categories(self._rules(config, after), list(config.categories))
            return config, after

        config, records = self.store.commit(change)
        return self._show(config, records, seen, folders)

    def _show(self, config, records, seen, folders) -> LibraryView:
        images = views.library_view(seen, records)
        if self.shrink:
            images = views.with_thumbnails(images, self.spark.read.schema("hash string, thumbnail string").parquet(f"{self._scans[-1]}/thumbnails"))
        images = images.orderBy(*views.order("library"))
        listed = self.spark.createDataFrame(folders, "name string, is_manual boolean")
        excluded = views.name_table(self.spark, list(config.excluded_analysis_folders))
        categories = views.name_table(self.spark, list(config.categories))
        counts = views.folder_counts(images, listed, excluded)
        return LibraryView(self.root, config, images, counts, views.categories_sorted(views.category_counts(images, categories)), views.unclassified_count(images))

    # --- configuration ---

    def set_source_pattern(self, preset: str | None = None, regex: str | None = None) -> documents.Config:
        paths.check_pattern(paths.effective_pattern(preset, regex))  # before anything is stored
        return self.store.configure(lambda c: c.with_(source_pattern_preset=preset, source_pattern_regex=regex))

    def add_folder(self, name: str) -> documents.Config:
        name = paths.check_name(name)
        if not os.path.isdir(f"{self.root}/{name}"):
            raise ValueError(f"{name} is no folder of the root")
        return self.store.configure(lambda c: c if name in c.manual_source_folders else c.with_(manual_source_folders=(*c.manual_source_folders, name)))

    def remove_folder(self, name: str) -> documents.Config:
        return self.store.configure(lambda c: c.with_(manual_source_folders=tuple(x for x in c.manual_source_folders if x != name)))

    def include_folder(self, name: str, included: bool) -> documents.Config:
        def change(c):
            rest = tuple(x for x in c.excluded_analysis_folders if x != name)
            return c.with_(excluded_analysis_folders=rest if included else (*rest, name))

        return self.store.configure(change)

    def set_thresholds(self, words: int | None = None, area: float | None = None, score: float | None = None) -> documents.Config:
        """Changes thresholds and classifies anew, without any inference; the text thresholds leave the score rule alone."""

        def change(c, r):
            c = c.with_(
                ocr_word_threshold=c.ocr_word_threshold if words is None else int(words),
                ocr_area_threshold=c.ocr_area_threshold if area is None else max(0.0, min(1.0, area)),
                nsfw_score_threshold=c.nsfw_score_threshold if score is None else max(0.0, min(1.0, score)),
            )
            c = self._with_builtins(c, r)
            return c, self._rules(c, r, ("text",) if score is None else ("score", "text"))

        return self.store.commit(change)[0]

    # --- categories ---

    def create_category(self, name: str) -> documents.Config:
        name = paths.check_name(name, "Category")

        def change(c):
            if any(edits.is_same_name(x, name) for x in c.categories):
                raise ValueError("That category already exists.")
            return c.with_(categories=(*c.categories, name))

        return self.store.configure(change)

    def rename_category(self, old: str, new: str) -> documents.Config:
        new = paths.check_name(new, "Category")

        def change(c, r):
            if old not in c.categories:
                raise ValueError("That category does not exist.")
            if any(edits.is_same_name(x, new) for x in c.categories):
                raise ValueError("That category already exists.")
            return c.with_(categories=tuple(new if x == old else x for x in c.categories)), edits.rename_category(r, old, new)

        return self.store.commit(change)[0]

    def delete_category(self, name: str) -> documents.Config:
        return self.store.commit(lambda c, r: (c.with_(categories=tuple(x for x in c.categories if x != name)), edits.delete_category(r, name)))[0]

    def assign(self, hash_: str, category: str | None) -> None:
        """Sets or clears one record's category by hand, without a scan."""

        def change(c, r):
            if category is not None and category not in c.categories:
                raise ValueError("That category does not exist.")
            one = self.spark.createDataFrame([(hash_, category, 0)], "hash string, category string, at int")
            return c, edits.assign(r, one, F.lit(self.now()))

        self.store.commit(change)

    # --- passes ---

    def run_pass(self, name: str, enrich: Enricher, force: bool = False, rows: int = C.CHECKPOINT_ROWS) -> str:
        """Runs a pass over what is pending and merges its results into what is stored by then, a batch at a time.

        Batches hold about ``rows`` files, or more of a large library, so that there are MOST_BATCHES of
        them at most; each is committed, so a failure or ``cancel`` loses one batch and the rest stays pending.
        ``progress`` events follow each batch and a ``finished`` event the last one.
        """
        key = (self.root, name)
        if key in _RUNNING:
            raise Busy(f"{name} is already running.")
        _RUNNING.add(key)
        message, error = "", None
        try:
            self.spark.sparkContext.setJobGroup(self._group(name), f"{name} of {self.root}", True)
            message = self._run(name, enrich, force, rows)
            return message
        except Exception as failure:
            error = str(failure)
            raise
        finally:
            _RUNNING.discard(key)
            _CANCELLED.discard(key)
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self.events("finished", {"pass": name, "message": message, "error": error})

    def _run(self, name: str, enrich: Enricher, force: bool, rows: int) -> str:
        key, which = (self.root, name), passes.PASSES[name]
        done = total = 0
        path = f"{self.store.folder}/results-{name}-{self.now().replace(':', '')}"
        try:
            view = self.scan()
            excluded = list(view.config.excluded_analysis_folders)
            if which.needs_folder:
                message = passes.folder_gate(not view.folders.isEmpty(), not view.folders.where("not excluded").isEmpty())
                if message:
                    return message
            config, records = self.store.read()
            images = view.images.drop("video_title").join(records.select("hash", "video_title"), "hash", "left")
            if name == "vision":
                todo = passes.vision_eligible(images, self.plan(), excluded, force, config.nsfw_score_threshold)
            else:
                todo = passes.pending(images, which, excluded, force, config.nsfw_score_threshold)
            once = todo.groupBy("hash").agg(F.max(F.struct("relative_path", "absolute_path", "name")).alias("f")).select("hash", "f.*")
            once.write.mode("overwrite").parquet(f"{path}/todo")
            once = self.spark.read.parquet(f"{path}/todo")
            total = once.count()
            batches = max(1, min(MOST_BATCHES, -(-total // rows)))
            for nth in range(batches):
                if key in _CANCELLED:
                    break
                part = once.where(F.pmod(F.xxhash64("hash"), F.lit(batches)) == nth) if batches > 1 else once
                enrich(part).write.mode("overwrite").parquet(f"{path}/{nth}")  # inference runs once
                results = self.spark.read.parquet(f"{path}/{nth}")
                self._merge(which, results)
                done += results.where(F.col(which.marker).isNotNull()).count()
                self.events("progress", {"pass": name, "done": done, "total": total})
        except Exception:
            if key not in _CANCELLED:
                raise
        finally:
            self.store.remove(path)
        if name == "chunk" and done:
            self.rebuild_plan()
        return f"Cancelled: {done} of {total} analyzed." if key in _CANCELLED else f"{done} analyzed."

    def _merge(self, which: passes.Pass, results: DataFrame) -> None:
        def change(c, r):
            after = reconcile.merge_columns(r, results, list(which.columns))
            c = self._with_builtins(c, after)
            return c, self._rules(c, after)

        self.store.commit(change)

    def run_queue(self, enrichers: dict[str, Enricher], force: bool = False) -> dict[str, str]:
        """Runs the passes that have an enricher in their order, one after the other; a cancelled one ends the queue."""
        said: dict[str, str] = {}
        for name in passes.QUEUE:
            if name in enrichers:
                said[name] = self.run_pass(name, enrichers[name], force)
                if said[name].startswith("Cancelled"):
                    break
        return said

    def _group(self, name: str) -> str:
        return f"lumenframe {self.root} {name}"

    def cancel(self, name: str) -> None:
        """Ends a running pass after what it has committed; the batch that runs is given up and stays pending."""
        if (self.root, name) in _RUNNING:
            _CANCELLED.add((self.root, name))
            self.spark.sparkContext.cancelJobGroup(self._group(name))

    def run_vision(self, make_client, encode, settings: documents.Settings, prompt: str, force: bool = False) -> str:
        """Describes eligible images, writes their documents and the index, and says how many failed or were skipped."""
        model, endpoint = settings.vision_model.strip() or C.DESCRIBE_MODEL, settings.vision_endpoint.strip() or C.DESCRIBE_ENDPOINT
        asked: list[DataFrame] = []
        paths_used: list[str] = []

        def enrich(todo: DataFrame) -> DataFrame:
            titles = self.store.read()[1].select("hash", "video_title")
            path = f"{self.store.folder}/descriptions-{self.now().replace(':', '')}"
            models.described(todo, make_client, encode, model, prompt).write.mode("overwrite").parquet(path)  # asked once
            found = self.spark.read.parquet(path)
            asked.append(found)
            paths_used.append(path)
            rows = found.where("description is not null").join(todo.select("hash", "relative_path", "name"), "hash").join(titles, "hash", "left")
            written = sinks.description_documents(rows, model, self.now())
            sinks.write_descriptions(written, self.root, self.names)
            return written.select("hash", "vision_desc_chars")

        skipped = {r.reason: r.n for r in self._skips().collect()}
        self.run_pass("vision", enrich, force)
        self.write_index()
        total = sum(x.count() for x in asked)
        if not total:
            return text.skip_notes(skipped.get("unscored", 0), skipped.get("explicit", 0), skipped.get("video", 0))
        failures = sum(x.where("description is null").count() for x in asked)
        for path in paths_used:
            self.store.remove(path)
        return text.described_summary(total - failures, failures, endpoint)

    def _skips(self) -> DataFrame:
        view = self.scan()
        return passes.skip_counts(view.images, self.plan(), list(view.config.excluded_analysis_folders), view.config.nsfw_score_threshold)

    # --- video plans ---

    def plan(self) -> DataFrame | None:
        return documents.read_plan(self.spark, documents.plan_path(self.root, self.names))

    def rebuild_plan(self, force: bool = False, samples: int = C.SAMPLES_PER_GROUP) -> DataFrame | None:
        """Groups the titled records anew; what was selected stays, unless forced.  No titles, no plan."""
        titled = self.store.read()[1].where(F.length("video_title") > 0).select("hash", F.col("video_title").alias("title"))
        if titled.isEmpty():
            self.discard_plan()
            return None
        plan = videos.plan_ordered(videos.build_plan(titled, samples, self.plan(), force))
        sinks.export_plan(plan, documents.plan_path(self.root, self.names), samples, self.now())
        return self.plan()

    def discard_plan(self) -> None:
        Path(documents.plan_path(self.root, self.names)).unlink(missing_ok=True)

    def write_index(self) -> str:
        path = f"{self.root}/{self.names.descriptions}/{C.INDEX_FILE}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        sinks.export_index(videos.description_index(self.store.read()[1]), path, self.now(), self.names)
        return path

    # --- files ---

    def import_images(self, target_folder: str, sources: list[str]) -> ImportReport:
        """Copies dropped images into a folder of the root under free names and lists the folder as a source."""
        name = paths.check_name(target_folder)
        found = files.import_sources(sources)
        if not found:
            raise ValueError("None of the dropped files is an image.")
        inside = [p for p in found if Path(os.path.abspath(p)).is_relative_to(self.root)]
        copies = [p for p in found if p not in inside]
        if not copies:
            raise ValueError("All dropped images lie inside this library.")
        target = Path(self.root, name)
        fresh = not target.is_dir()
        target.mkdir(exist_ok=True)
        report = ImportReport(0, len(inside), name)
        for source in copies:
            try:
                shutil.copyfile(source, free_name(target, Path(source).name))
                report.imported += 1
            except OSError as error:
                report.skipped += 1
                if len(report.errors) < C.MAX_IMPORT_ERRORS:
                    report.errors.append(f"{Path(source).name}: {error}")
        if report.imported:
            self.add_folder(name)
        elif fresh and not any(target.iterdir()):
            target.rmdir()
        return report

    def move_image(self, hash_: str, relative_path: str, target_folder: str) -> str:
        """Moves one file into a folder of the root; its record follows only if it was of that very file."""
        root, source = Path(self.root).resolve(), Path(self.root, relative_path)
        if not source.resolve().is_file():
            raise ValueError(f"{relative_path} is not there any more")
        if not source.resolve().is_relative_to(root):
            raise ValueError(f"{relative_path} lies outside the root")
        target = root / paths.check_name(target_folder)
        target.mkdir(exist_ok=True)
        source = source.resolve()
        place = source if source.parent == target else free_name(target, source.name)
        if place != source:
            source.rename(place)
        moved = place.relative_to(root).as_posix()
        hit = (F.col("hash") == hash_) & (F.col("last_known_path") == relative_path)
        self.store.commit(lambda c, r: (c, r.withColumn("last_known_path", F.when(hit, F.lit(moved)).otherwise(F.col("last_known_path")))))
        return moved


def free_name(folder: Path, name: str) -> Path:
    """The name itself, or the first of ``name (2)``, ``name (3)`` that isn't taken."""
    place, n = folder / name, 2
    while place.exists():
        place, n = folder / f"{Path(name).stem} ({n}){Path(name).suffix}", n + 1
    return place


def scheduled_refresh(spark: SparkSession, settings: documents.Settings, enrichers: dict[str, Enricher], cancelled: Callable[[], bool] = lambda: False) -> documents.Settings:
    """Scans the settings' roots one after the other and runs the chosen passes in their order; a root that fails isn't counted."""
    done, stopped = 0, False
    for root in settings.auto_refresh_roots:
        if stopped := cancelled():
            break
        try:
            library = Library(spark, root)
            library.scan()
        except (OSError, ValueError):
            continue
        for name in passes.SCHEDULED:
            if name in settings.auto_refresh_passes and name in enrichers and not cancelled():
                library.run_pass(name, enrichers[name])
        done += 1
    summary = text.folder_summary(done, len(settings.auto_refresh_roots), stopped)
    return documents.replace(settings, last_auto_refresh_summary=summary)
