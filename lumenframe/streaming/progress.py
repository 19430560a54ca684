"""Progress of incremental passes, as events for whoever shows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class PassProgress(StreamingQueryListener):
    """Calls ``progress(name, rows so far)`` after each batch and ``finished(name, error or None)`` at the end."""

    def __init__(self, progress: Callable[[str, int], None], finished: Callable[[str, str | None], None]):
        self._progress, self._finished = progress, finished
        self._rows: dict[str, int] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        key = str(event.progress.id)
        self._rows[key] = self._rows.get(key, 0) + event.progress.numInputRows
        self._progress(self._names.get(key, key), self._rows[key])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        key = str(event.id)
        self._finished(self._names.get(key, key), event.exception)
