"""Steps between a source and its tables: filters, state machines over the order, block ranges, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.errors import RollbackBehindHistory, SlotBoundsInvalid
from tidemark.operators.ordered import previous, running_sum, scan


def map_event(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The event mapped; null means nothing to store, while the row's position still counts as seen."""
    return rows.withColumn(name, value)


def first_of_epoch(rows: DataFrame) -> DataFrame:
    """The first row of each epoch: those whose predecessor has another epoch."""
    out = previous(rows, "slot_no", F.col("epoch_no"), "_before")
    return out.where(F.col("_before").isNull() | (F.col("_before") != F.col("epoch_no"))).drop("_before")


def expanded(log: DataFrame, steps: Column, width: int) -> DataFrame:
    """Each row becomes the rows of an array of structs, `width` at most, control rows included; `seq` keeps the order."""
    rows = log.select("seq", F.posexplode(steps).alias("_i", "_s"))
    return rows.select((F.col("seq") * width + F.col("_i")).alias("seq"), "_s.*")


def fold(rows: DataFrame, total: Callable[[Column], Column], value: Column, combine: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Any fold that is an associative aggregate, such as F.max, with `combine` for two of its results; a null value carries
    the one before."""
    return scan(rows, "slot_no", name, total, value, combine)


def running_fold(rows: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """The fold's value after each row; a null value carries the one before."""
    return running_sum(rows, "slot_no", F.coalesce(value, F.lit(0)), name)


def block_range(low: int, high: int) -> tuple[int, int]:
    if not 0 < low <= high:
        raise SlotBoundsInvalid(f"not a block range: {low}..{high}")
    return low, high


def in_block_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(F.col("block_no").between(*block_range(low, high)))


def just_before_range(rows: DataFrame, low: int) -> DataFrame:
    """The block before a range, or its first block if the range begins at 0."""
    return rows.where(F.col("block_no") == (low - 1 if low > 0 else low))


def tracked_addresses(rows: DataFrame, addresses: list, column: str = "address") -> DataFrame:
    """Rows of the listed addresses; an empty list tracks all."""
    return rows.where(F.col(column).isin(addresses)) if addresses else rows


def without_scripts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def tracked_assets(rows: DataFrame, assets: list[tuple]) -> DataFrame:
    """Rows of the listed (policy, name); a name of None stands for every asset of the policy."""
    keep = F.lit(False)
    for policy, name in assets:
        keep = keep | ((F.col("policy_id") == policy) & (F.lit(True) if name is None else F.col("asset_name") == name))
    return rows.where(keep)


def delayed(rows: DataFrame, capacity: int) -> DataFrame:
    """Rows that `capacity` newer ones have confirmed: the newest are held back, and a rollback among them costs nothing."""
    if capacity <= 0:
        return rows
    held = rows.select("slot_no").orderBy(F.desc("slot_no")).limit(capacity).agg(F.min("slot_no").alias("_edge"))
    return rows.join(F.broadcast(held), F.col("slot_no") < F.col("_edge")).drop("_edge")


def keep_last(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n newest rows, or the n newest of each key."""
    if not keys:
        return rows.orderBy(F.desc("slot_no")).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("slot_no")))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def pruned(rows: DataFrame, point: int) -> DataFrame:
    """What is left after everything up to a position was pruned."""
    return rows.where(F.col("slot_no") > point)


def check_pruned(point: int | None, to_slot: int | None) -> None:
    if point is not None and (to_slot is None or to_slot < point):
        raise RollbackBehindHistory(f"slot {to_slot} is before the pruned position {point}")


def first_sighting(rows: DataFrame, key: str, *ties: str) -> DataFrame:
    """One row per key: the one seen first. Later ones are ignored."""
    best = F.min_by(F.struct(*rows.columns), F.struct("slot_no", *ties)).alias("_first")
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(best).select("_first.*")
