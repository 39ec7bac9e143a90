"""Tables other than the given ones: what a larger or another chain brings."""

from __future__ import annotations

import os

import pytest

from tests.chain import block, output, tx
from tests.oracle import connect, rows_of_frame, rows_of_sql
from tidemark import registry, schemas
from tidemark.plans import catalogue
from tidemark.sources import chain, event_store, files
from tidemark.streaming.delay import Delay
from tidemark.streaming.ingest import TABLES, Ingest, Settings


@pytest.fixture
def late(spark, sf_dir, tmp_path):
    """Events in which the policy of the queries is first seen after the slot that they ask for."""
    for name in os.listdir(sf_dir):
        if name != "events.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(f"user_id <> {catalogue.POLICY}")
    last = events.orderBy("event_id").limit(1).selectExpr("event_id + 10000000 AS event_id", "ts", f"{catalogue.POLICY}L AS user_id", "'purchase' AS event_type", "value", "props")
    events.unionByName(last).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_policy_seen_later(spark, late):
    assert rows_of_frame(registry.queries()["burn_by_policy_bounds"](spark, late)) == rows_of_sql(connect(late), registry.oracle_sql()["burn_by_policy_bounds"])


def in_rows(rows: list[tuple], size: int) -> list[tuple]:
    """The same log with blocks of at most so many transactions a row."""
    cut = lambda b: [b | {"txs": b["txs"][i : i + size], "first_tx": i} for i in range(0, max(1, len(b["txs"])), size)]
    return [(seq, op, to, b) for seq, op, to, whole in rows for b in ([whole] if whole is None else cut(whole))]


def log_of_blocks() -> list[tuple]:
    made = lambda s: [tx(f"t{s}-{i}", [output("a", i)], [(f"t{s - 1}-{i}", 0)], witness_datums={f"h{i % 2}": "d"}) for i in range(s % 4)]
    rows = [(s, "INDEX", None, block(s, s, s, made(s))) for s in range(1, 8)] + [(8, "ROLLBACK", 5, None)]
    return rows + [(s, "INDEX", None, block(s, s - 3, s - 3, made(s), "b")) for s in range(9, 12)]


def test_blocks_in_rows(spark, tmp_path):
    """A block that comes in several rows is one block, with the same tables, whatever is rolled back or held back."""
    found = []
    for size in (100, 1):
        rows = in_rows(log_of_blocks(), size)
        at = max(i for i, r in enumerate(rows) if r[0] == 6) + 1
        ingest = Ingest(spark, f"{tmp_path}/{size}", TABLES, Settings(depth=2, flush_every=2))
        delay = Delay(spark, f"{tmp_path}/held-{size}", 2, ingest.process)
        for i, part in enumerate((rows[:at], rows[at:])):
            delay.process(spark.createDataFrame(part, schemas.STREAM), i)
        event_store.write_range(spark.createDataFrame(rows, schemas.STREAM), 3, 5, f"{tmp_path}/range-{size}")
        txs = spark.read.parquet(f"{tmp_path}/range-{size}/blocks").selectExpr("slot_no", "explode_outer(txs.tx_id) t")
        found.append([*(rows_of_frame(ingest.table(t.name)) for t in TABLES), ingest.point(), delay.held().select("slot_no").distinct().count(), rows_of_frame(txs.where("t is not null"))])
    assert found[0] == found[1]
    assert found[0][6] == 2 and len(found[0][0][1]) == 6


def test_parts_of_a_log(spark, tmp_path):
    """A part has as many files as its size asks for, all of them newer than those of the part before."""
    rows = in_rows(log_of_blocks(), 1)
    spark.createDataFrame(rows, schemas.STREAM).write.parquet(f"{tmp_path}/all")
    each = chain.write_in_order(spark, f"{tmp_path}/all", f"{tmp_path}/log", 2, file_bytes=3000)
    found = sorted(files.listed(spark, f"{tmp_path}/log", ".parquet"), key=lambda f: os.path.getmtime(f.removeprefix("file:")))
    assert each > 1 and len(found) == 2 * each
    old, new = ([r.seq for r in chain.read_log(spark, *f).collect()] for f in (found[:each], found[each:]))
    assert sorted(old + new) == sorted(r[0] for r in rows) and max(old) < min(new)
