"""From nested blocks to the rows of the tables. Blocks that have a `seq` hand it on to their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seq(rows: DataFrame) -> list[str]:
    return ["seq"] if "seq" in rows.columns else []


def heads(blocks: DataFrame) -> DataFrame:
    """One row per block: of those that a block may come as, the first."""
    return blocks.where(F.coalesce("first_tx", F.lit(0)) == 0) if "first_tx" in blocks.columns else blocks


def count_heads() -> Column:
    """How many blocks the rows of a stream have."""
    return F.count_if((F.col("op") == "INDEX") & (F.coalesce("block.first_tx", F.lit(0)) == 0))


def block_info(blocks: DataFrame) -> DataFrame:
    return heads(blocks).select("slot_no", "block_hash", "block_no", F.floor("block_time").cast("bigint").alias("block_timestamp"), "epoch_no", *_seq(blocks))


#: What the tables need of a transaction.
OUTPUTS, INPUTS = ("tx_id", "script_valid", "outputs", "collateral_return"), ("tx_id", "script_valid", "inputs", "collateral_inputs")
DATUMS, MINTS = ("witness_datums", "outputs"), ("tx_id", "mint", "redeemers")


def transactions(blocks: DataFrame, *fields: str) -> DataFrame:
    """A row per transaction with its index in the block; with only some of its fields, so that files are read for no others."""
    txs = F.arrays_zip(*(f"txs.{f}" for f in fields)) if fields else F.col("txs")
    before = F.coalesce("first_tx", F.lit(0)) if "first_tx" in blocks.columns else F.lit(0)
    rows = blocks.select(*_seq(blocks), "slot_no", "block_hash", "block_no", before.cast("bigint").alias("_before"), F.posexplode(txs).alias("tx_index", "tx"))
    return rows.withColumn("tx_index", F.col("tx_index") + F.col("_before")).drop("_before")


def outputs(txs: DataFrame) -> DataFrame:
    """Outputs that the transaction created: with an invalid script only its collateral return, at index 0."""
    back = F.when(F.col("tx.collateral_return").isNotNull(), F.array("tx.collateral_return"))
    made = F.when(F.col("tx.script_valid"), F.col("tx.outputs")).otherwise(back)
    rows = txs.select(*_seq(txs), "slot_no", "block_hash", "tx_index", F.col("tx.tx_id").alias("tx_id"), F.posexplode(made).alias("tx_ix", "o"))
    datum = F.coalesce("o.datum_hash", F.when(F.col("o.inline_datum").isNotNull(), F.sha2("o.inline_datum", 256)))
    return rows.select("o.address", "tx_index", "tx_id", "tx_ix", datum.alias("datum_hash"), "o.value", "o.script", "o.script_hash", "slot_no", "block_hash", *_seq(txs))


def inputs(txs: DataFrame) -> DataFrame:
    """Outputs that the transaction spent: with an invalid script its collateral."""
    used = F.when(F.col("tx.script_valid"), F.col("tx.inputs")).otherwise(F.col("tx.collateral_inputs"))
    rows = txs.select(*_seq(txs), "slot_no", "block_hash", F.col("tx.tx_id").alias("spent_at_tx"), F.explode(used).alias("i"))
    return rows.select("i.tx_id", "i.tx_ix", "spent_at_tx", "slot_no", "block_hash", *_seq(txs))


def datums(txs: DataFrame) -> DataFrame:
    """Witness and inline data of each block by hash; of one hash a witness goes before an inline datum."""
    at = [*_seq(txs), "slot_no", "block_hash"]
    seen = txs.select(*at, F.explode("tx.witness_datums").alias("datum_hash", "datum")).withColumn("kind", F.lit(0))
    inline = txs.select(*at, F.explode("tx.outputs").alias("o")).where("o.inline_datum is not null")
    inline = inline.select(*at, F.sha2("o.inline_datum", 256).alias("datum_hash"), F.col("o.inline_datum").alias("datum"), F.lit(1).alias("kind"))
    best = F.min_by("datum", F.struct("kind", "datum")).alias("datum")
    return seen.unionByName(inline).groupBy(*at, "datum_hash").agg(best).select("datum_hash", "datum", *at)


def mints(txs: DataFrame) -> DataFrame:
    """Minted (positive) and burnt (negative) assets; the redeemer is that of the policy's index among the policies."""
    policies = F.array_sort(F.array_distinct(F.transform("tx.mint", lambda m: m["policy_id"])))
    rows = txs.select(*_seq(txs), "slot_no", "block_hash", "block_no", "tx_index", F.col("tx.tx_id").alias("tx_id"), policies.alias("policies"), F.col("tx.redeemers").alias("redeemers"), F.explode("tx.mint").alias("m"))
    place = F.array_position("policies", F.col("m.policy_id")) - 1
    own = F.get(F.filter("redeemers", lambda r: r["ix"] == place), F.lit(0))
    return rows.select("slot_no", "block_hash", "block_no", "tx_id", "tx_index", "m.policy_id", "m.asset_name", "m.quantity", own["redeemer_hash"].alias("redeemer_hash"), own["redeemer"].alias("redeemer"), *_seq(txs))


def stake_by_pool(delegations: DataFrame, stake: DataFrame) -> DataFrame:
    """Stake of each pool: delegations (credential, pool_id) joined with stake (credential, lovelace)."""
    return delegations.join(stake, "credential").groupBy("pool_id").agg(F.sum("lovelace").alias("lovelace"))


def address_counts(outs: DataFrame) -> DataFrame:
    """Outputs per address and block."""
    return outs.groupBy("address", "slot_no", "block_hash").agg(F.count("*").alias("count"))
