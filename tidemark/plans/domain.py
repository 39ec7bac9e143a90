"""Questions about outputs, spends, data, blocks, assets and epochs, as of a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import SlotBoundsInvalid
from tidemark.operators import generic, intervals
from tidemark.operators.preprocess import first_sighting, tracked_assets


def spent_once(spent: DataFrame) -> DataFrame:
    """One spend per output: the earliest."""
    rest = [c for c in spent.columns if c not in ("tx_id", "tx_ix")]
    first = F.min_by(F.struct(*rest), F.struct("slot_no", "spent_at_tx")).alias("s")
    return spent.groupBy("tx_id", "tx_ix").agg(first).select("tx_id", "tx_ix", *(f"s.{c}" for c in rest))


def spends_of(spent: DataFrame, outputs: DataFrame) -> DataFrame:
    """The spends of these outputs only, so that nothing is grouped that is not asked for."""
    return spent.join(outputs.select("tx_id", "tx_ix"), ["tx_id", "tx_ix"], "left_semi")


def unspent(utxo: DataFrame, spent: DataFrame, upper: int | None, lower: int | None = None) -> DataFrame:
    """Outputs created at or before `upper` (and at or after `lower`) that no transaction had spent by then.

    An output spent at `upper` itself is gone. Without an upper bound, at genesis, an output counts if it never is spent.
    """
    made = utxo if upper is None else utxo.where(F.col("slot_no") <= upper)
    made = made if lower is None else made.where(F.col("slot_no") >= lower)
    gone = spent if upper is None else spent.where(F.col("slot_no") <= upper)
    return made.join(gone.select("tx_id", "tx_ix"), ["tx_id", "tx_ix"], "left_anti")


def lifetimes(utxo: DataFrame, spent: DataFrame) -> DataFrame:
    """Outputs with the slot that made them and the one that spent them, null if none did: what `intervals` asks."""
    first = spent_once(spent).select("tx_id", "tx_ix", "spent_at_tx", F.col("slot_no").alias("spent_slot"))
    return utxo.join(first, ["tx_id", "tx_ix"], "left")


def unspent_with_spend(outputs: DataFrame, spent: DataFrame, upper: int | None) -> DataFrame:
    """The outputs that were unspent at `upper`, with their later spend. Only the spends of these outputs are grouped, once."""
    rows = lifetimes(outputs, spends_of(spent, outputs))
    return rows.where(F.col("spent_slot").isNull() if upper is None else F.col("spent_slot").isNull() | (F.col("spent_slot") > upper))


def unspent_at_many(utxo: DataFrame, spent: DataFrame, questions: DataFrame) -> DataFrame:
    """For each question (address, at) the outputs of the address that were unspent at that slot."""
    return intervals.stabbed(lifetimes(utxo, spent).withColumnRenamed("slot_no", "created"), questions, ["address"], "created", "spent_slot", "at")


def balance_at_many(utxo: DataFrame, spent: DataFrame, questions: DataFrame) -> DataFrame:
    """For each question (address, at) how many outputs were unspent then, and their value."""
    rows = lifetimes(utxo, spent).withColumnRenamed("slot_no", "created")
    return intervals.stabbed_sums(rows, questions, ["address"], "created", "spent_slot", "at", n_outputs=F.lit(1), value=F.col("value"))


def unspent_details(utxo: DataFrame, spent: DataFrame, datum: DataFrame, blocks: DataFrame, address: Column, upper: int | None, lower: int | None = None) -> DataFrame:
    """Unspent outputs of an address with their datum, block, the inputs of the creating transaction, and the spend that
    comes later, if one does. Inputs are gathered per transaction before the join, so nothing fans out."""
    made = generic.until(utxo.where(F.col("address") == address), upper)
    made = made if lower is None else made.where(F.col("slot_no") >= lower)
    rows = unspent_with_spend(made, spent, upper)
    keys = rows.select("tx_id").distinct()
    used = spent.withColumnRenamed("spent_at_tx", "by").join(keys.withColumnRenamed("tx_id", "by"), "by")
    used = used.groupBy("by").agg(F.sort_array(F.collect_set(F.struct("tx_id", "tx_ix"))).alias("tx_inputs")).withColumnRenamed("by", "tx_id")
    info = blocks.select("slot_no", "block_no", "epoch_no", "block_timestamp")
    at_spend = info.select(F.col("slot_no").alias("spent_slot"), F.col("block_no").alias("spent_block_no"))
    out = rows.join(datum.select("datum_hash", "datum"), "datum_hash", "left")
    return out.join(used, "tx_id", "left").join(info, "slot_no", "left").join(at_spend, "spent_slot", "left")


def latest_outputs(utxo: DataFrame, as_of: int | None = None) -> DataFrame:
    """All outputs of the newest block that has any."""
    rows = generic.until(utxo, as_of)
    return rows.join(F.broadcast(rows.agg(F.max("slot_no").alias("_newest"))), F.col("slot_no") == F.col("_newest")).drop("_newest")


def resolve_datum(datum: DataFrame, datum_hash: str, as_of: int | None = None) -> DataFrame:
    """A datum by its hash, if it was seen by then; the first sighting counts."""
    return generic.until(first_sighting(datum.where(F.col("datum_hash") == datum_hash), "datum_hash", "datum"), as_of)


def by_sign(rows: DataFrame, kind: str | None) -> DataFrame:
    """'mint' keeps quantities above 0, 'burn' below; 0 is neither."""
    if kind is None:
        return rows
    return rows.where(F.col("quantity") > 0) if kind == "mint" else rows.where(F.col("quantity") < 0)


def lower_slot_of(rows: DataFrame, tx_id, upper: int | None) -> int:
    """The slot of a transaction that is to bound a query from below."""
    found = generic.until(rows, upper).where(F.col("tx_id") == tx_id).agg(F.min("slot_no")).first()[0]
    if found is None:
        raise SlotBoundsInvalid(f"the lower bound {tx_id} is not known up to slot {upper}")
    return found


def check_upper(upper: int | None, as_of: int | None) -> None:
    if upper is not None and (as_of is None or upper > as_of):
        raise SlotBoundsInvalid(f"the upper bound {upper} is after the position {as_of}")


def asset_events(rows: DataFrame, policy, name=None, kind: str | None = None, upper: int | None = None, lower_tx=None, as_of: int | None = None) -> DataFrame:
    """Events of a policy, oldest first; the lower bound is the slot of a transaction, itself included."""
    check_upper(upper, as_of)
    upper = as_of if upper is None else upper
    out = by_sign(generic.until(tracked_assets(rows, [(policy, name)]), upper), kind)
    if lower_tx is not None:
        out = out.where(F.col("slot_no") >= lower_slot_of(rows, lower_tx, upper))
    return out.orderBy("slot_no", "block_no", "tx_index")


def with_depth_stability(rows: DataFrame, blocks: DataFrame, upper: int, depth: int) -> DataFrame:
    """Stability as it was at an upper bound: a block is stable if it lies `depth` or more below the bound's block."""
    top = blocks.where(F.col("slot_no") == upper).agg(F.max("block_no")).first()[0]
    if top is None:
        raise SlotBoundsInvalid(f"there is no block at slot {upper}")
    return rows.withColumn("is_stable", F.col("block_no") <= F.lit(top - depth))


def active_stake(sdd: DataFrame, epoch: int) -> DataFrame:
    """The stake that is active in an epoch was recorded two epochs before; its own epoch number is reported."""
    return sdd.where(F.col("epoch_no") == epoch - 2)


def nonce_of(nonces: DataFrame, epoch: int) -> DataFrame:
    return nonces.where(F.col("epoch_no") == epoch).orderBy("slot_no").limit(1)


def sync_point(blocks: DataFrame, tip: DataFrame, last_sync: int | None) -> DataFrame:
    """The newest block at or before the position at which all tables agree, with the tip of the source."""
    newest = generic.last_event(generic.until(blocks, last_sync), "block_no", "epoch_no", "block_timestamp")
    return newest.crossJoin(tip)  # one row each


def address_count(counts: DataFrame, address: Column, as_of: int | None) -> DataFrame:
    """How many outputs an address got; 0 for an unknown one and at genesis."""
    return generic.until(counts, as_of).where(F.col("address") == address).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
