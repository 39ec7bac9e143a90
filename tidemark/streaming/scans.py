"""Scans over a stream that a rollback undoes: a running fold, and the change of epoch.

What is not final is kept as it came, slot by slot: that is the undo log. A rollback takes rows out of it, and what follows is
folded anew from the last final state when the result is read. Rows that become final are folded once, written, and leave
the log; one row of state says what they add up to. So a batch costs its own rows and `depth` blocks.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changelog, extract
from tidemark.operators.ordered import previous, scan
from tidemark.sources import files
from tidemark.streaming.commits import Commits

_KEPT = "slot_no bigint, block_no bigint, tip_block_no bigint, epoch_no bigint, value bigint"
_ROWS = "slot_no bigint, epoch_no bigint, total bigint, first_of_epoch boolean"


@dataclasses.dataclass
class _State:
    batch: int = -1
    sources: dict[str, int] = dataclasses.field(default_factory=dict)
    kept: str | None = None
    stable: int | None = None
    total: int | None = None  # of the final rows
    epoch: int | None = None  # of the last final row
    some: bool = False  # whether there is one


class Scan:
    """Folds `value`, read from a block, with an associative aggregate and what joins two of its results."""

    def __init__(self, spark: SparkSession, root: str, depth: int, value: str, total: Callable[[Column], Column] = F.sum, combine: Callable[[Column, Column], Column] = lambda a, b: a + b):
        self.spark, self.root, self.depth, self.value = spark, root.rstrip("/"), depth, value
        self.total, self.combine = total, combine
        self._commits = Commits(spark, f"{self.root}/_state")

    def state(self) -> _State:
        text = self._commits.read()
        return _State(**json.loads(text)) if text else _State()

    def _kept(self, state: _State) -> DataFrame:
        return self.spark.read.schema(_KEPT).parquet(f"{self.root}/{state.kept}") if state.kept else self.spark.createDataFrame([], _KEPT)

    def _scanned(self, rows: DataFrame, state: _State) -> DataFrame:
        """The rows with what the fold is after each of them, and whether their epoch is another than before."""
        out = scan(rows, "slot_no", "_here", self.total, F.col("value"), self.combine)
        base = F.lit(state.total).cast("bigint")
        both = F.when(F.col("_here").isNull(), base).when(base.isNull(), F.col("_here")).otherwise(self.combine(F.col("_here"), base))
        out = previous(out.withColumn("total", both), "slot_no", F.struct("epoch_no"), "_prior")
        changed = F.when(F.col("_prior").isNotNull(), ~F.col("_prior.epoch_no").eqNullSafe(F.col("epoch_no")))
        first = F.lit(not state.some) | ~F.col("epoch_no").eqNullSafe(F.lit(state.epoch).cast("bigint"))
        return out.select("slot_no", "epoch_no", F.col("total").cast("bigint").alias("total"), F.coalesce(changed, first).alias("first_of_epoch"))

    def process(self, batch: DataFrame, batch_id: int, source: str = "") -> None:
        """The body of foreachBatch: rows of schemas.STREAM."""
        state = self.state()
        if batch_id <= state.sources.get(source, -1):
            return
        batch = batch.persist()
        try:
            is_ = lambda op: F.count_if(F.col("op") == op)
            back = F.min(F.when(F.col("op") == "ROLLBACK", F.coalesce("to_slot", F.lit(-1))))
            seen = batch.agg(extract.count_heads().alias("blocks"), is_("ROLLBACK").alias("rollbacks"), back.alias("back")).first()
            changelog.check_target(seen.back, state.stable)
            flat = extract.heads(batch.where("op = 'INDEX'").select("seq", "block.*")).withColumn("value", F.expr(self.value).cast("bigint"))
            own = flat.select("seq", "slot_no", "block_no", "tip_block_no", "epoch_no", "value")
            before = self._kept(state)
            valid = changelog.after_batch(before, own, batch, seen.rollbacks, seen.blocks).where("valid").select(*before.columns).persist()
            found = changelog.stable_point(valid, self.depth).first()[0]
            stable = state.stable if found is None else found
            new = dataclasses.replace(state, batch=state.batch + 1, sources=state.sources | {source: batch_id}, kept=f"kept-{state.batch + 1:012d}", stable=stable)
            final = valid.where(F.lit(stable is not None) & (F.col("slot_no") <= F.lit(stable).cast("bigint")))
            # of a batch without final rows there is an empty folder, and the state stays
            self._scanned(final, state).write.mode("overwrite").parquet(f"{self.root}/rows/batch={new.batch}")
            last = final.agg(self.total(F.col("value")).alias("total"), F.max_by("epoch_no", "slot_no").alias("epoch"), F.count("*").alias("many")).first()
            if last.many:
                new.epoch, new.some = last.epoch, True
                parts = [x for x in (state.total, last.total) if x is not None]
                new.total = parts[0] if len(parts) == 1 else None if not parts else self.spark.range(1).select(self.combine(*(F.lit(x).cast("bigint") for x in reversed(parts)))).first()[0]
            valid.where(F.lit(stable is None) | (F.col("slot_no") > F.lit(stable).cast("bigint"))).repartition(1).write.mode("overwrite").parquet(f"{self.root}/{new.kept}")
            self._commits.write(json.dumps(dataclasses.asdict(new)))
            if state.kept:
                files.remove(self.spark, f"{self.root}/{state.kept}")
            valid.unpersist()
        finally:
            batch.unpersist()

    def start(self, log: DataFrame, checkpoint: str, available_now: bool = True):
        source = checkpoint.rstrip("/")
        writer = log.writeStream.foreachBatch(lambda batch, i: self.process(batch, i, source)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def rows(self) -> DataFrame:
        """(slot_no, epoch_no, total, first_of_epoch) of every valid block."""
        state = self.state()
        if state.batch < 0:
            return self.spark.createDataFrame([], _ROWS)
        final = self.spark.read.schema(_ROWS + ", batch bigint").parquet(f"{self.root}/rows").where(F.col("batch") <= state.batch).drop("batch")
        return final.unionByName(self._scanned(self._kept(state), state))
