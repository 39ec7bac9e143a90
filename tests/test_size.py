"""What keeps tasks and memory bounded when tables are large."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from tests.chain import block, output, tx
from tests.oracle import connect, rows_of_frame, rows_of_sql
from tests.test_larger import in_rows, log_of_blocks
from tidemark import registry, schemas
from tidemark.functions import datum
from tidemark.operators import extract, intervals
from tidemark.plans import chainlog
from tidemark.sources import chain, files
from tidemark.sources.shared import released
from tidemark.streaming import ingest as ingest_
from tidemark.streaming.ingest import TABLES, Ingest, Settings


def test_large_batch_is_written_down(spark, tmp_path, monkeypatch):
    """A large batch is not kept in memory, gives the same tables, and leaves nothing behind."""
    rows, found, seen = in_rows(log_of_blocks(), 1), [], []
    for most in (200_000, 3):
        monkeypatch.setattr(ingest_, "IN_MEMORY", most)
        ingest = Ingest(spark, f"{tmp_path}/{most}", TABLES, Settings(depth=2, flush_every=2, actions=(lambda b: seen.append(len(b.inputFiles())),)))
        ingest.process(spark.createDataFrame(rows, schemas.STREAM), 0)
        found.append([rows_of_frame(ingest.table(t.name)) for t in TABLES])
        assert not files.exists(spark, f"{tmp_path}/{most}/_batch")
    assert found[0] == found[1] and seen[0] == 0 and seen[1] > 0


def test_stored_batches_are_not_copied(spark, tmp_path, monkeypatch):
    """Batches of a log's files are read where they lie, column by column: no copy is written, and the tables are the same."""
    monkeypatch.setattr(ingest_, "IN_MEMORY", 3)
    rows, found, written = in_rows(log_of_blocks(), 1), [], []
    each = chain.write_parts(spark.createDataFrame(rows, schemas.STREAM), f"{tmp_path}/log", 2)
    monkeypatch.setattr(ingest_.files, "remove", lambda spark, path, remove=files.remove: (written.append(path.endswith("/_batch")), remove(spark, path)))
    for named in (False, True):
        seen = []
        ingest = Ingest(spark, f"{tmp_path}/tables-{named}", TABLES[:2], Settings(depth=2, flush_every=2, actions=(lambda b, seen=seen: seen.append(b.select("seq", "slot_no").distinct().count()),)))
        if named:
            stream = ingest.start_files(chain.stream_names(spark, f"{tmp_path}/log", each), f"{tmp_path}/log", f"{tmp_path}/checkpoint-{named}")
        else:
            stream = ingest.start(chain.stream_log(spark, f"{tmp_path}/log", each), f"{tmp_path}/checkpoint-{named}")
        stream.awaitTermination()
        found.append([*(rows_of_frame(ingest.table(t.name)) for t in TABLES[:2]), ingest.point(), seen])
        assert any(written) != named and ingest.state().batch == 1
        written.clear()
    assert found[0] == found[1]


def test_log_is_made_of_small_rows(spark, sf_dir):
    """What is gathered per transaction are lines as they are, not outputs with their maps."""
    plan = chainlog.log(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list(" in line]
    assert gathered and not any("map(" in line or "md5(" in line for line in gathered)


def test_merged_run_has_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest_, "RUN_FILES", 3)
    ingest = Ingest(spark, f"{tmp_path}/t", TABLES[:2], Settings(depth=1, flush_every=1, merge=2, file_rows=1))
    for i in range(2):
        made = [(s, "INDEX", None, block(s, s, s, [tx(f"t{s}-{k}", [output(f"a{k}", 1)]) for k in range(4)])) for s in range(1 + 9 * i, 10 + 9 * i)]
        ingest.process(spark.createDataFrame(made, schemas.STREAM), i)
    run = next(r for r in ingest.state().cold if r.level == 1)
    assert 1 < len(files.listed(spark, f"{tmp_path}/t/utxo/segment={run.name}", ".parquet")) <= 4
    assert ingest.table("utxo").count() == 18 * 4


def test_tables_read_their_fields_only(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    spark.createDataFrame(log_of_blocks(), schemas.STREAM).write.parquet(f"{tmp_path}/log")
    blocks = chain.read_log(spark, f"{tmp_path}/log").where("op = 'INDEX'").select("seq", "block.*")
    for fields, made in ((extract.OUTPUTS, extract.outputs), (extract.INPUTS, extract.inputs), (extract.DATUMS, extract.datums), (extract.MINTS, extract.mints)):
        some, whole = made(extract.transactions(blocks, *fields)), made(extract.transactions(blocks))
        assert rows_of_frame(some) == rows_of_frame(whole)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in plan and ("collateral_inputs" in plan.split("ReadSchema")[1]) == (fields == extract.INPUTS)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_parts_in_one_pass(spark, tmp_path):
    """Parts come from one job, in the order of their files' times, as many files each."""
    rows = in_rows(log_of_blocks(), 1)
    frame = spark.createDataFrame(rows, schemas.STREAM).repartition(3)
    each = chain.write_parts(frame, f"{tmp_path}/log", 2)
    found = files.listed(spark, f"{tmp_path}/log", ".parquet")
    assert len(found) == 2 * each
    parts = [sorted(r.seq for r in chain.read_log(spark, *f).collect()) for f in (found[:each], found[each:])]
    assert sorted(parts[0] + parts[1]) == sorted(r[0] for r in rows) and max(parts[0]) < min(parts[1])
    assert max(files.changed(spark, f) for f in found[:each]) < min(files.changed(spark, f) for f in found[each:])
    assert not files.exists(spark, f"{tmp_path}/log-parts")


def test_stake_does_not_run_the_stream(spark, sf_dir, monkeypatch):
    """Stake and nonces come from their own tables."""

    def never(*_):
        raise AssertionError("the stream was run")

    monkeypatch.setattr(chainlog, "ingested", never)
    for name in ("rpc_active_stake", "rpc_nonce"):
        assert rows_of_frame(registry.queries()[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), registry.oracle_sql()[name])


def test_headers_are_the_blocks(spark, sf_dir):
    """Positions are known without lines being put together."""
    own = [c for c in chainlog.headers(spark, sf_dir).columns if c != "txs"]
    assert rows_of_frame(chainlog.headers(spark, sf_dir).select(own)) == rows_of_frame(extract.heads(chainlog.blocks(spark, sf_dir)).select(own))
    assert "collect_list" not in chainlog.log(spark, sf_dir, chainlog.headers(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()


def test_few_points_go_to_the_intervals(spark, monkeypatch):
    """The same pairs by the points of each key and by the nodes; intervals of keys that nobody asks for are left out."""
    made = spark.createDataFrame([(k, i % 11, None if i % 5 == 0 else i % 11 + i % 4) for k in range(6) for i in range(40)] + [(1, None, 3), (None, 1, 9)], "k int, low bigint, high bigint")
    asked = spark.createDataFrame([(k, p, f"q{p}") for k in (1, 2, 9) for p in (0, 4, 4, 7, 12, None)] + [(None, 4, "n")], "k int, p bigint, name string")
    few = intervals.stabbed(made, asked, ["k"], "low", "high", "p")
    sums = lambda: intervals.stabbed_sums(made, asked, ["k"], "low", "high", "p", n=F.lit(1))
    some = sums()
    assert "_node" not in few._jdf.queryExecution().analyzed().toString() and "LeftSemi" in some._jdf.queryExecution().optimizedPlan().toString()
    found = [rows_of_frame(few), rows_of_frame(some)]
    monkeypatch.setattr(intervals, "ASKED_KEYS", 0)
    assert found == [rows_of_frame(intervals.stabbed(made, asked, ["k"], "low", "high", "p")), rows_of_frame(sums())]
    assert len(found[0][1]) > 0


def test_data_are_dealt_before_they_are_taken_apart(spark, monkeypatch):
    """However few blocks of files have them, many tasks take data apart, and their nodes are not dealt again."""
    monkeypatch.setattr(datum, "ROWS", 10)
    texts = spark.range(95).coalesce(1).selectExpr("id", """'{"map":[{"k":{"int":' || id || '},"v":{"list":[{"bytes":"0a"}]}}]}' AS d""")
    found = datum.nodes(texts, ["id"], "d", 4)
    assert found.select(F.spark_partition_id()).distinct().count() > 5
    out = datum.written(found, ["id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows_of_frame(out.select("id", "datum")) == rows_of_frame(texts.select("id", F.col("d").alias("datum")))


def test_shuffles_are_released(spark, tmp_path):
    """What a query shuffled goes when it ends, not when the driver next clears its memory (F1)."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b.toString() for b in map(manager.getAllBlocks().apply, range(manager.getAllBlocks().size())) if b.isShuffle()}
    made = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled()
    with released(spark):
        made.write.parquet(f"{tmp_path}/released")
        assert rows_of_frame(made) == rows_of_frame(made)
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
    made.write.parquet(f"{tmp_path}/kept")
    assert shuffled() - before


def test_large_run_is_dealt_by_stretches(spark, tmp_path, monkeypatch):
    """A merged run of many rows is dealt one stretch of the curve after the other, with the same rows, files and lookups (F1)."""
    found, passes = [], []
    monkeypatch.setattr(ingest_.layout, "laid_out", lambda rows, *a, laid_out=ingest_.layout.laid_out: (passes.append(a[0]), laid_out(rows, *a))[1])
    for most in (1_000_000, 10):
        monkeypatch.setattr(ingest_, "AT_ONCE", most)
        ingest = Ingest(spark, f"{tmp_path}/{most}", TABLES[1:2], Settings(depth=1, flush_every=1, merge=2, file_rows=10))
        for i in range(2):
            made = [(s, "INDEX", None, block(s, s, s, [tx(f"t{s}-{k}", [output(f"a{k}", 1)]) for k in range(8)])) for s in range(1 + 9 * i, 10 + 9 * i)]
            ingest.process(spark.createDataFrame(made, schemas.STREAM), i)
        run = next(r for r in ingest.state().cold if r.level == 1)
        assert len(files.listed(spark, f"{tmp_path}/{most}/utxo/segment={run.name}", ".zstd.parquet")) > 4
        found.append([rows_of_frame(x) for x in (ingest.table("utxo"), ingest.lookup("utxo", "a3", 2, 12), ingest.of_transaction("utxo", "t5-5"))])
        passes.append(None)
    assert found[0] == found[1] and len(found[0][1][1]) == 11 and len(found[0][2][1]) == 1
    assert passes.count("address") == 5 and passes.index(None) == 2


def test_consumed_log_goes(spark, tmp_path):
    """A log that is the stream's own goes file by file as batches are committed; another stays (F1)."""
    rows, there = in_rows(log_of_blocks(), 1), []
    for clean in (False, True):
        folder = f"{tmp_path}/log-{clean}"
        each = chain.write_parts(spark.createDataFrame(rows, schemas.STREAM), folder, 4)
        ingest = Ingest(spark, f"{tmp_path}/tables-{clean}", TABLES[:2], Settings(depth=2, flush_every=2))
        ingest.start_files(chain.stream_names(spark, folder, each, clean), folder, f"{tmp_path}/checkpoint-{clean}").awaitTermination()
        there.append((len(files.listed(spark, folder, ".parquet")) / each, [rows_of_frame(ingest.table(t.name)) for t in TABLES[:2]]))
    assert there[0][0] == 4 and there[1][0] < 4 and there[0][1] == there[1][1]


def test_ingested_log_does_not_stay(spark, sf_dir, monkeypatch):
    """When the tables are made, nothing of the log that they were made of is left on disk (F1)."""
    made = []
    monkeypatch.setattr(chainlog, "new_folder", lambda *a, new=chainlog.new_folder: made.append(new(*a)) or made[-1])
    ingest = chainlog._ingested.__wrapped__("F1", spark, sf_dir, "F1")
    assert not any(p.endswith(".parquet") and "/log" in p for p in files.listed(spark, made[0]))
    assert ingest.table("utxo").count() > 0 and os.path.basename(made[0]).startswith("chain-")
