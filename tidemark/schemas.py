"""Table schemas. A position is (slot_no, block_hash); genesis has both null. Order is by slot, identity by both."""

from __future__ import annotations

CHANGE_LOG = "seq bigint, op string, slot_no bigint, block_hash string, block_no bigint, epoch_no bigint, block_time bigint, tip_block_no bigint, to_slot bigint"

VALUE = "map<string, map<string, decimal(38,0)>>"
OUTPUT = f"struct<address: string, value: {VALUE}, datum_hash: string, inline_datum: string, script: string, script_hash: string>"
TX = (
    "struct<tx_id: string, script_valid: boolean, inputs: array<struct<tx_id: string, tx_ix: int>>, "
    f"collateral_inputs: array<struct<tx_id: string, tx_ix: int>>, outputs: array<{OUTPUT}>, collateral_return: {OUTPUT}, "
    "witness_datums: map<string, string>, "
    "mint: array<struct<policy_id: string, asset_name: string, quantity: decimal(38,0)>>, "
    "redeemers: array<struct<ix: int, redeemer_hash: string, redeemer: string>>>"
)
_BLOCK = {"slot_no": "bigint", "block_hash": "string", "block_no": "bigint", "epoch_no": "bigint", "block_time": "double", "tip_block_no": "bigint", "txs": f"array<{TX}>", "first_tx": "bigint"}
#: A block with many transactions comes as several rows with one `seq`, alike but for `txs` and for `first_tx`, the place in the
#: block of their first transaction; the row with 0 (or null) stands for the block.
BLOCK = ", ".join(f"{n} {t}" for n, t in _BLOCK.items())
#: A recorded stream: a block for INDEX, a slot to go back to for ROLLBACK.
STREAM = f"seq bigint, op string, to_slot bigint, block struct<{', '.join(f'{n}: {t}' for n, t in _BLOCK.items())}>"

UTXO = f"address string, tx_index bigint, tx_id string, tx_ix int, datum_hash string, value {VALUE}, script string, script_hash string, slot_no bigint, block_hash string"
SPENT = "tx_id string, tx_ix int, spent_at_tx string, slot_no bigint, block_hash string"
DATUM = "datum_hash string, datum string, slot_no bigint, block_hash string"
BLOCK_INFO = "slot_no bigint, block_hash string, block_no bigint, block_timestamp bigint, epoch_no bigint"
MINT = "slot_no bigint, block_hash string, block_no bigint, tx_id string, tx_index bigint, policy_id string, asset_name string, quantity decimal(38,0), redeemer_hash string, redeemer string"
EPOCH_SDD = "epoch_no bigint, pool_id string, lovelace decimal(38,0), block_no bigint, slot_no bigint, block_hash string"
EPOCH_NONCE = "epoch_no bigint, nonce string, block_no bigint, slot_no bigint, block_hash string"
PROGRESS = "batch_id bigint, table_name string, last_sync bigint, last_stable bigint, pruned bigint"
