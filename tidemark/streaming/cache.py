"""Results kept for the current position."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame

from tidemark.errors import AheadOfLastSync


class ResultCache:
    """Keeps a query's result at the newest position. Older positions go past it; a new position brings it up to date
    with `update` if there is one, and a rollback makes it ask again."""

    def __init__(self, query: Callable[[Hashable, int | None], DataFrame], update: Callable[[DataFrame, Hashable, int, int], DataFrame] | None = None):
        self.query, self.update = query, update
        self.at: int | None = None
        self.kept: dict[Hashable, DataFrame] = {}

    def get(self, key: Hashable, as_of: int | None) -> DataFrame:
        if as_of is not None and self.at is not None and as_of < self.at:
            return self.query(key, as_of)
        if as_of is not None and (self.at is None or as_of > self.at):
            raise AheadOfLastSync(f"asked for slot {as_of}, synced to {self.at}", self.kept.get(key))
        if key not in self.kept:
            self.kept[key] = self.query(key, self.at).persist()
        return self.kept[key]

    def advanced(self, slot: int) -> None:
        old, self.at = self.at, slot
        for key, frame in list(self.kept.items()):
            if self.update is None or old is None:
                frame.unpersist()
                del self.kept[key]
            else:
                self.kept[key] = self.update(frame, key, old, slot).persist()

    def rolled_back(self, slot: int | None) -> None:
        self.at = slot
        for frame in self.kept.values():
            frame.unpersist()
        self.kept.clear()
