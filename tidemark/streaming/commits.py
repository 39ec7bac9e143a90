"""One row of state that says how far a writer came."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.sources import files

_TEXT = "number bigint, state string"


class Commits:
    """Writes the row in turn to two places, so that one of them always is whole; the larger number counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.number: int | None = None

    def read(self) -> str | None:
        """The newest state, None if there is none."""
        places = [p for p in (f"{self.folder}/{i}" for i in (0, 1)) if files.exists(self.spark, p)]
        rows = [tuple(r) for r in self.spark.read.schema(_TEXT).parquet(*places).collect()] if places else []
        self.number, text = max(rows, default=(0, None))
        return text

    def write(self, text: str) -> None:
        if self.number is None:
            self.read()
        self.number += 1
        row = self.spark.createDataFrame([(self.number, text)], _TEXT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{self.number % 2}")
