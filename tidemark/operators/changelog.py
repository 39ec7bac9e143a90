"""The change log: rows that roll forward (INDEX) and back (ROLLBACK), and what they leave valid.

`seq` is the order of arrival. An INDEX row is valid if no later ROLLBACK goes back to before its slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ResumingFailed
from tidemark.operators.ordered import suffix_min


def as_known_at(log: DataFrame, seq: int) -> DataFrame:
    """The log as far as it had arrived."""
    return log.where(F.col("seq") <= seq)


def as_log(forward: DataFrame, back: DataFrame) -> DataFrame:
    """Positions (seq, slot_no and more) and rollbacks (seq, to_slot) as one log."""
    index = forward.withColumns({"op": F.lit("INDEX"), "to_slot": F.lit(None).cast("bigint")})
    return index.unionByName(back.withColumn("op", F.lit("ROLLBACK")), allowMissingColumns=True)


def judged(log: DataFrame, buckets: int | None = None, order: str = "seq") -> DataFrame:
    """The log with `valid`, true for the INDEX rows of the canonical chain; `order` is the order of arrival."""
    back = F.when(F.col("op") == "ROLLBACK", F.coalesce("to_slot", F.lit(-1)))
    least = suffix_min(log, order, back, "_least", buckets=buckets)
    return least.withColumn("valid", (F.col("op") == "INDEX") & (F.col("_least").isNull() | (F.col("_least") >= F.col("slot_no")))).drop("_least")


def after_batch(before: DataFrame, own: DataFrame, batch: DataFrame, rollbacks: int, blocks: int) -> DataFrame:
    """Rows that were valid before a batch and those of its blocks (own, with seq), with `valid` after the batch's rollbacks.

    All that was before came earlier than the batch, whatever its numbers."""
    log = before.withColumn("_at", F.lit(None).cast("bigint")).unionByName(own.withColumn("_at", F.col("seq")), allowMissingColumns=True)
    if not rollbacks:
        return log.withColumn("valid", F.lit(True)).drop("_at")  # there is nothing to scan
    back = batch.where("op = 'ROLLBACK'").select(F.col("seq").alias("_at"), "to_slot")
    return judged(as_log(log, back), max(1, blocks // 100_000), "_at").where("op = 'INDEX'").drop("_at", "op", "to_slot")


def valid_rows(log: DataFrame, buckets: int | None = None) -> DataFrame:
    """The INDEX rows of the canonical chain."""
    return judged(log, buckets).where("valid").drop("valid")


def rolled_back(rows: DataFrame, to_slot: int | None) -> DataFrame:
    """A table after a rollback; None is genesis and empties it."""
    return rows.where(F.lit(False)) if to_slot is None else rows.where(F.col("slot_no") <= to_slot)


def stable_floor(rows: DataFrame, depth: int) -> DataFrame:
    """One row: the highest block number that is final, that is more than `depth` below the tip."""
    return rows.agg((F.max("tip_block_no") - F.lit(depth)).alias("floor"))


def stable_point(rows: DataFrame, depth: int) -> DataFrame:
    """One row: the newest slot whose block is strictly below the floor; null while nothing is final."""
    final = rows.join(F.broadcast(stable_floor(rows, depth)), F.col("block_no") < F.col("floor"))
    return final.agg(F.max("slot_no").alias("stable_slot"))


def with_stability(rows: DataFrame, stable_slot: int | Column | None) -> DataFrame:
    """Tags rows at or before the last stable position; before there is one nothing is stable."""
    if stable_slot is None:
        return rows.withColumn("is_stable", F.lit(False))
    edge = stable_slot if isinstance(stable_slot, Column) else F.lit(stable_slot)
    return rows.withColumn("is_stable", F.coalesce(F.col("slot_no") <= edge, F.lit(False)))


def resumed(log: DataFrame, last_stable: int | None) -> DataFrame:
    """What is left to process after a restart: rows after the last stable position."""
    if last_stable is None:
        return log
    return log.where(((F.col("op") == "INDEX") & (F.col("slot_no") > last_stable)) | ((F.col("op") == "ROLLBACK") & (F.col("to_slot") > last_stable)))


def check_rollbacks(log: DataFrame, last_stable: int | None) -> None:
    """Fails if the source goes back behind what is final. A rollback to the stable position itself is fine."""
    check_target(log.where("op = 'ROLLBACK'").agg(F.min(F.coalesce("to_slot", F.lit(-1)))).first()[0], last_stable)


def check_target(least: int | None, last_stable: int | None) -> None:
    """The same for the least slot that rollbacks go to."""
    if last_stable is not None and least is not None and least < last_stable:
        raise ResumingFailed(f"a rollback goes behind the stable slot {last_stable}")


def distance(rows: DataFrame) -> DataFrame:
    """Blocks between a row and the tip it came with; a tip at genesis counts as block 0."""
    return rows.withColumn("distance", F.coalesce("tip_block_no", F.lit(0)) - F.col("block_no"))
