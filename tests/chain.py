"""Seeded random chains and a plain model of the change log."""

from __future__ import annotations

import random
from decimal import Decimal


def items(seed: int, n: int, depth: int = 10, rollback: float = 0.1) -> list[tuple]:
    """(seq, op, slot_no, to_slot); rollbacks go back to one of the last `depth` valid slots."""
    rng, out, chain, slot = random.Random(seed), [], [], 0
    for seq in range(n):
        if chain and rng.random() < rollback:
            to = rng.choice(chain[-depth:])
            chain = [s for s in chain if s <= to]
            slot = to
            out.append((seq, "ROLLBACK", None, to))
        else:
            slot += rng.randint(1, 3)
            chain.append(slot)
            out.append((seq, "INDEX", slot, None))
    return out


def model(rows: list[tuple]) -> list[tuple]:
    """The valid (seq, slot) after all rows."""
    chain: list[tuple] = []
    for seq, op, slot, to in rows:
        if op == "INDEX":
            chain.append((seq, slot))
        else:
            chain = [c for c in chain if c[1] <= to]
    return chain


def block(slot: int, number: int, tip: int, txs: list[dict], fork: str = "a") -> dict:
    return {"slot_no": slot, "block_hash": f"{fork}{slot}", "block_no": number, "epoch_no": slot // 5, "block_time": slot * 20.7, "tip_block_no": tip, "txs": txs}


def output(address: str, ada: int, **more) -> dict:
    base = {"address": address, "value": {"": {"": Decimal(ada)}}, "datum_hash": None, "inline_datum": None, "script": None, "script_hash": None}
    return base | more


def tx(tx_id: str, outputs: list[dict], inputs: list[tuple] = (), valid: bool = True, **more) -> dict:
    ref = lambda xs: [{"tx_id": t, "tx_ix": i} for t, i in xs]
    base = {"tx_id": tx_id, "script_valid": valid, "inputs": ref(inputs), "collateral_inputs": [], "outputs": outputs, "collateral_return": None, "witness_datums": {}, "mint": [], "redeemers": []}
    more = {k: ref(v) if k == "collateral_inputs" else v for k, v in more.items()}
    return base | more
