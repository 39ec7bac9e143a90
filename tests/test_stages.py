"""Stages of the stream against a plain model: delay, and scans that rollbacks undo, however the log is cut into batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.chain import block, items, model, output, tx
from tidemark import errors, schemas
from tidemark.plans import domain
from tidemark.streaming.delay import Delay
from tidemark.streaming.ingest import TABLES, Ingest, Settings
from tidemark.streaming.scans import Scan
from tidemark.streaming.stack import Stack, TipFile, tips


def log_of(seed, n, depth):
    log = items(seed, n, depth=depth, rollback=0.2)
    rows = []
    for seq, op, slot, to in log:
        rows.append((seq, op, to, block(slot, slot, slot, []) if op == "INDEX" else None))
    return log, rows


def cut(rows, seed, parts):
    rng = random.Random(seed)
    edges = sorted({0, len(rows), *(rng.randint(1, len(rows) - 1) for _ in range(parts))})
    return [rows[a:b] for a, b in zip(edges[:-1], edges[1:])]


@pytest.mark.parametrize(("seed", "capacity", "depth"), [(1, 4, 12), (2, 15, 6), (3, 0, 6)])
def test_delay(spark, tmp_path, seed, capacity, depth):
    """Rollbacks within what is held never go on; deeper ones do."""
    log, rows = log_of(seed, 70, depth)
    ingest = Ingest(spark, str(tmp_path / "tables"), TABLES[:1], Settings(depth=60))
    went = []

    def then(out, number):
        went.append(out.where("op = 'ROLLBACK'").count())
        ingest.process(out, number)

    delay = Delay(spark, str(tmp_path / "held"), capacity, then)
    at = 0
    for i, part in enumerate(cut(rows, seed, 4)):
        delay.process(spark.createDataFrame(part, schemas.STREAM), i)
        delay.process(spark.createDataFrame(part, schemas.STREAM), i) if capacity else None  # again, after a failure: nothing happens
        at += len(part)
        slots = [s for _, s in model(log[:at])]
        assert sorted(r.slot_no for r in ingest.table("block_info").collect()) == slots[: max(0, len(slots) - capacity)]
        if capacity:
            assert sorted(r.slot_no for r in delay.held().collect()) == slots[-capacity:]
    if capacity > depth:
        assert sum(went) == 0


def expected(slots):
    total, before, out = 0, None, []
    for s in slots:
        total += s % 7
        out.append((s, s // 5, total, before != s // 5))
        before = s // 5
    return out


@pytest.mark.parametrize(("seed", "parts"), [(4, 1), (4, 4)])
def test_scans(spark, tmp_path, seed, parts):
    log, rows = log_of(seed, 60, 6)
    scan = Scan(spark, str(tmp_path / "scan"), 20, "slot_no % 7")
    assert scan.rows().collect() == []
    at = 0
    for i, part in enumerate(cut(rows, seed, parts)):
        scan.process(spark.createDataFrame(part, schemas.STREAM), i)
        scan.process(spark.createDataFrame(part, schemas.STREAM), i)
        at += len(part)
        assert sorted(map(tuple, scan.rows().collect())) == expected([s for _, s in model(log[:at])])
    assert scan.state().stable is not None
    with pytest.raises(errors.ResumingFailed):
        scan.process(spark.createDataFrame([(900, "ROLLBACK", scan.state().stable - 1, None)], schemas.STREAM), 50)


def test_other_folds(spark, tmp_path):
    scan = Scan(spark, str(tmp_path / "scan"), 2, "case when slot_no % 3 = 0 then slot_no end", F.max, F.greatest)
    for i, slots in enumerate(([1, 2, 3], [4, 5], [9, 10])):
        scan.process(spark.createDataFrame([(s, "INDEX", None, block(s, s, s, [])) for s in slots], schemas.STREAM), i)
    assert sorted((r.slot_no, r.total) for r in scan.rows().collect()) == [(1, None), (2, None), (3, 3), (4, 3), (5, 3), (9, 9), (10, 9)]


def test_stack(spark, tmp_path):
    """Filtered, delayed and indexed; positions stay where nothing is left of a block."""
    made = lambda s: [tx(f"t{s}", [output("a", 1)]), tx(f"u{s}", [output("b", 1)])]
    rows = [(s, "INDEX", None, block(s, s, s, made(s) if s % 2 else [])) for s in range(1, 9)] + [(9, "ROLLBACK", 6, None)]
    tip = TipFile(spark, str(tmp_path / "tip"), 2)
    stack = Stack(spark, str(tmp_path / "stack"), TABLES[:2], Settings(depth=3, actions=(tip,)), delay=2, keep=lambda t: t["tx_id"].startswith("t"))
    for i, at in enumerate(range(0, 9, 4)):
        stack.process(spark.createDataFrame(rows[at : at + 4], schemas.STREAM), i)
    assert sorted(r.slot_no for r in stack.ingest.table("block_info").collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.tx_id for r in stack.ingest.table("utxo").collect()) == ["t1", "t3", "t5"]
    assert tip.read() == {"slot_no": 6, "block_hash": "a6", "block_no": 6, "tip_block_no": 6}


def test_tip_file(spark, tmp_path):
    tip = TipFile(spark, str(tmp_path), 5)
    assert tip.read() is None
    told = []
    for slots in ([1, 2], [3], [7, 9], [4]):
        tip(spark.createDataFrame([(s, s, f"a{s}", s, s + 1) for s in slots], "seq long, slot_no long, block_hash string, block_no long, tip_block_no long"))
        told.append(tip.read()["block_no"])
    assert told == [2, 2, 9, 4]  # written again when far enough, and when the chain went back


def test_tips_in_a_log(spark):
    """A rollback leaves a row at its position, until a later one goes further back."""
    rows = [(0, "INDEX", 1, None, 9), (1, "INDEX", 5, None, 9), (2, "ROLLBACK", None, 3, 10), (3, "INDEX", 6, None, 11), (4, "ROLLBACK", None, 1, 12), (5, "INDEX", 8, None, 12)]
    log = spark.createDataFrame(rows, "seq long, op string, slot_no long, to_slot long, tip_block_no long")
    found = sorted((r.slot_no, r.tip_block_no, r.tip_only) for r in tips(log).collect())
    assert found == [(1, 9, False), (1, 12, True), (8, 12, False)]


def test_assets_come_oldest_first(spark):
    rows = [(s, s // 2, i, "p", "a", (-1) ** i) for s, i in [(9, 1), (3, 0), (9, 0), (4, 2), (3, 2)]]
    frame = spark.createDataFrame(rows, "slot_no long, block_no long, tx_index long, policy_id string, asset_name string, quantity long").repartition(4)
    assert [(r.slot_no, r.tx_index) for r in domain.asset_events(frame, "p").collect()] == [(3, 0), (3, 2), (4, 2), (9, 0), (9, 1)]


def test_scan_carries_large_totals(spark, tmp_path):
    """Totals that each fit into 32 bits add up to more."""
    scan = Scan(spark, str(tmp_path / "scan"), 1, "1000000000")
    for i, slots in enumerate(([1, 2, 3], [4], [5])):
        scan.process(spark.createDataFrame([(s, "INDEX", None, block(s, s, s, [])) for s in slots], schemas.STREAM), i)
    assert sorted((r.slot_no, r.total) for r in scan.rows().collect()) == [(n, n * 10**9) for n in range(1, 6)]
