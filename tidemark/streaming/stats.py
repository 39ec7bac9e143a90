"""Progress of an ingest: counts since the last report, and how far the tip is."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

logger = logging.getLogger("tidemark")


class SyncStats:
    """Counts blocks and rollbacks between reports; `report` hands them to every backend and starts anew. How far the tables
    and the tip are may be told in slots or, as Ingest does, in blocks."""

    def __init__(self, *backends: Callable[[dict], None], clock: Callable[[], float] = time.monotonic):
        self.backends, self.clock = backends, clock
        self.total = {"blocks": 0, "rollbacks": 0}
        self._start()

    def _start(self) -> None:
        self.blocks = self.rollbacks = 0
        self.since = self.clock()

    def seen(self, blocks: int, rollbacks: int, sync_slot: int | None, tip_slot: int | None) -> None:
        self.blocks += blocks
        self.rollbacks += rollbacks
        self.total["blocks"] += blocks
        self.total["rollbacks"] += rollbacks
        self.sync_slot, self.tip_slot = sync_slot, tip_slot

    def report(self) -> dict:
        seconds = max(self.clock() - self.since, 1e-9)
        out = {"blocks": self.blocks, "rollbacks": self.rollbacks, "blocks_per_second": self.blocks / seconds, "sync_slot": getattr(self, "sync_slot", None), "tip_slot": getattr(self, "tip_slot", None)}
        out["percent"] = percent(out["sync_slot"], out["tip_slot"])
        for backend in self.backends:
            backend(out)
        self._start()
        return out


def percent(slot: int | None, tip: int | None) -> float:
    return 0.0 if slot is None or not tip else 100 * slot / tip


def line(stats: dict) -> str:
    """One line for a log."""
    p = stats["percent"]
    if p >= 99.995:
        state = "Almost synced" if p < 100 else "Synced"
    else:
        state = f"Synchronising. {p:.2f} %"
    return f"{state} at {stats['sync_slot']} of {stats['tip_slot']}: {stats['blocks']} blocks ({stats['blocks_per_second']:.0f} blocks/s), {stats['rollbacks']} rollbacks since the last report"


def log_backend(stats: dict) -> None:
    logger.info(line(stats))


def metrics_text(stats: SyncStats) -> str:
    """Totals in the text format that metric collectors read."""
    return "".join(f"# TYPE tidemark_{k}_total counter\ntidemark_{k}_total {v}\n" for k, v in stats.total.items())


class Tracer(StreamingQueryListener):
    """Logs the life of streaming queries, and keeps what it saw."""

    def __init__(self) -> None:
        self.events: list[tuple[str, object]] = []

    def _note(self, what: str, detail: object = None) -> None:
        self.events.append((what, detail))
        logger.info("%s %s", what, detail)

    def onQueryStarted(self, event) -> None:
        self._note("started", str(event.id))

    def onQueryProgress(self, event) -> None:
        self._note("indexed", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._note("idle")

    def onQueryTerminated(self, event) -> None:
        self._note("failed" if event.exception else "closed", event.exception)
