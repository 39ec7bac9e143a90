"""Delay as a stage of the stream: blocks are passed on when so many newer ones confirm them.

The newest `capacity` valid blocks are held back in a table. A batch meets them: what its rollbacks take back among them is
gone and never reaches what comes after. Blocks that fall behind the newest are passed on in order of slots, and a rollback
goes on only if it reaches behind what is held. Blocks of one chain have one order, so they cannot be dealt by a key; the
order is cut into ranges instead (`ordered`), and no task holds more than a range.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import changelog, extract
from tidemark.sources import files
from tidemark.streaming.commits import Commits


@dataclasses.dataclass
class _State:
    batch: int = -1
    sources: dict[str, int] = dataclasses.field(default_factory=dict)
    held: str | None = None
    passed: int | None = None  # the newest slot that went on
    number: int = 0  # for the rows that go on, in their own order of arrival


class Delay:
    """`then` gets the rows that go on (of schemas.STREAM) and the batch's number, and may get them again after a failure."""

    def __init__(self, spark: SparkSession, root: str, capacity: int, then: Callable[[DataFrame, int], None]):
        self.spark, self.root, self.capacity, self.then = spark, root.rstrip("/"), capacity, then
        self._commits = Commits(spark, f"{self.root}/_state")

    def state(self) -> _State:
        text = self._commits.read()
        return _State(**json.loads(text)) if text else _State()

    def held(self) -> DataFrame:
        """The blocks that are held back."""
        return self._held(self.state())

    def _held(self, state: _State) -> DataFrame:
        return self.spark.read.schema(schemas.BLOCK).parquet(f"{self.root}/{state.held}") if state.held else self.spark.createDataFrame([], schemas.BLOCK)

    def process(self, batch: DataFrame, batch_id: int, source: str = "") -> None:
        """The body of foreachBatch, as of Ingest."""
        state = self.state()
        if batch_id <= state.sources.get(source, -1):
            return
        if self.capacity <= 0:
            self.then(batch, batch_id)
            return
        batch = batch.persist()
        try:
            is_ = lambda op: F.count_if(F.col("op") == op)
            back = F.min(F.when(F.col("op") == "ROLLBACK", F.coalesce("to_slot", F.lit(-1))))
            seen = batch.agg(extract.count_heads().alias("blocks"), is_("ROLLBACK").alias("rollbacks"), is_("STOP").alias("stops"), back.alias("back")).first()
            before, own = self._held(state), batch.where("op = 'INDEX'").select("seq", "block.*")
            valid = changelog.after_batch(before, own, batch, seen.rollbacks, seen.blocks).where("valid").select(*before.columns).persist()
            held = extract.heads(valid).select("slot_no").orderBy(F.desc("slot_no")).limit(self.capacity)
            edge = held.agg(F.min("slot_no").alias("slot"), F.count("*").alias("many")).first()
            new = f"{state.batch + 1:012d}"
            kept = valid if edge.many < self.capacity else valid.where(F.col("slot_no") >= edge.slot)
            kept.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/{new}")
            on = valid.where(F.lit(False)) if edge.many < self.capacity else valid.where(F.col("slot_no") < edge.slot)
            span = on.agg(F.min("slot_no").alias("low"), F.max("slot_no").alias("high")).first()
            start, passed = state.number, state.passed
            at = (F.col("slot_no") - F.lit(span.low or 0) + start + 1).alias("seq")
            rows = on.select(at, F.lit("INDEX").alias("op"), F.lit(None).cast("bigint").alias("to_slot"), F.struct(*before.columns).alias("block"))
            if seen.back is not None and passed is not None and seen.back < passed:
                rows = self.spark.createDataFrame([(start, "ROLLBACK", seen.back, None)], schemas.STREAM).unionByName(rows)
                passed = seen.back
            if seen.stops:
                rows = rows.unionByName(batch.where("op = 'STOP'"))
            self.then(rows, batch_id)
            passed = span.high if span.high is not None else passed
            number = start + 2 + ((span.high - span.low) if span.high is not None else 0)
            self._commits.write(json.dumps(dataclasses.asdict(_State(state.batch + 1, state.sources | {source: batch_id}, new, passed, number))))
            if state.held:
                files.remove(self.spark, f"{self.root}/{state.held}")
            valid.unpersist()
        finally:
            batch.unpersist()

    def start(self, log: DataFrame, checkpoint: str, available_now: bool = True):
        source = checkpoint.rstrip("/")
        writer = log.writeStream.foreachBatch(lambda batch, i: self.process(batch, i, source)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
