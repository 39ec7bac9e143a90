from __future__ import annotations

import json
import random
import threading
import urllib.request
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.chain import block, items, model, output, tx
from tidemark import errors, schemas
from tidemark.serving import cli, rpc
from tidemark.serving.rpc import Api, serve
from tidemark.sources import chain as source
from tidemark.sources import event_store
from tidemark.streaming import layout, stats
from tidemark.streaming.cache import ResultCache
from tidemark.streaming.ingest import TABLES, Ingest, Settings, configured, epoch_tables, for_each

MINT = {"policy_id": "p", "asset_name": "t", "quantity": Decimal(-3)}


def rows():
    """Two forks: block b6 replaces a6, where output t1#0 was spent."""
    one = block(2, 1, 3, [tx("t1", [output("addr", 5, inline_datum="d"), output("addr2", 1)], witness_datums={"h": "w"}, mint=[MINT], redeemers=[{"ix": 0, "redeemer_hash": "rh", "redeemer": "r"}])])
    two = block(6, 2, 3, [tx("t2", [output("addr", 4)], [("t1", 0)])])
    fork = block(7, 2, 3, [tx("t3", [output("addr", 3)], [("t1", 1)]), tx("t4", [output("lost", 9)], [("t1", 0)], valid=False, collateral_inputs=[("t9", 0)], collateral_return=output("back", 1))], "b")
    three = block(9, 3, 5, [], "b")
    return [(0, "INDEX", None, one), (1, "INDEX", None, two), (2, "ROLLBACK", 2, None), (3, "INDEX", None, fork), (4, "INDEX", None, three)]


def write(spark, folder, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schemas.STREAM).coalesce(1).write.parquet(f"{folder}/{i}")


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("ingest"))
    r = rows()
    write(spark, f"{top}/log", [r[:2], r[2:3], r[3:]])
    caught: list[int] = []
    ingest = Ingest(spark, f"{top}/tables", settings=Settings(depth=2, on_caught_up=caught.append, caught_up_distance=3))
    query = ingest.start(source.stream_log(spark, f"{top}/log/*", files_per_batch=1), f"{top}/checkpoint")
    query.awaitTermination()
    return ingest, caught


def test_tables_follow_the_canonical_chain(ingested):
    ingest, caught = ingested
    ids = lambda name, *c, **k: sorted(tuple(r[x] for x in c) for r in ingest.table(name, **k).collect())
    assert ids("utxo", "tx_id", "tx_ix", "address") == [("t1", 0, "addr"), ("t1", 1, "addr2"), ("t3", 0, "addr"), ("t4", 0, "back")]
    assert ids("spent", "tx_id", "tx_ix", "spent_at_tx") == [("t1", 1, "t3"), ("t9", 0, "t4")]
    assert ids("block_info", "slot_no", "block_hash", "block_timestamp") == [(2, "a2", 41), (7, "b7", 144), (9, "b9", 186)]
    assert ids("datum", "datum") == [("d",), ("w",)]
    assert ids("mint", "asset_name", "quantity", "redeemer") == [("t", Decimal(-3), "r")]
    assert ids("utxo", "tx_id", "tx_ix", as_of=2) == [("t1", 0), ("t1", 1)]
    assert ingest.point() == (9, 7)
    assert ids("block_info", "slot_no", "is_stable") == [(2, True), (7, True), (9, False)]
    assert caught == [6]
    with pytest.raises(errors.AheadOfLastSync):
        ingest.table("utxo", as_of=10)


def test_serving(ingested, spark, monkeypatch):
    ingest, _ = ingested
    sdd = spark.createDataFrame([(3, "pool", Decimal(10**20), 1, 15, "h")], "epoch_no bigint, pool_id string, lovelace decimal(38,0), block_no bigint, slot_no bigint, block_hash string")
    api = Api(ingest, ["addr", "addr2"], {"epoch_sdd": sdd, "epoch_nonce": sdd.withColumnRenamed("pool_id", "nonce")}, depth=1)
    call = lambda method, params=None: json.loads(api.call(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    assert call("echo", "x")["result"] == "x" and call("getTargetAddresses")["result"] == ["addr", "addr2"]
    found = call("getUtxosFromAddress", {"address": "addr"})["result"]
    assert [(r["txId"], r["txIx"], r["slotNo"], r["value"]) for r in found] == [("t1", 0, 2, {"": {"": 5}}), ("t3", 0, 7, {"": {"": 3}})]
    assert found[0]["datum"] == "d" and found[1]["txInputs"] == [{"txId": "t1", "txIx": 1}]
    early = call("getUtxosFromAddress", {"address": "addr2", "unspentBeforeSlotNo": 6})["result"]
    assert early[0]["spentBy"] == {"slotNo": 7, "txId": "t3"}
    burn = call("getBurnTokenEvents", {"policyId": "p"})["result"]
    assert burn == [{"slotNo": 2, "blockHeaderHash": "a2", "blockNo": 1, "txId": "t1", "redeemerHash": "rh", "redeemer": "r", "assetName": "t", "burnAmount": 3, "isStable": True}]
    assert call("getBurnTokenEvents", {"policyId": "p", "createdBeforeSlotNo": 2})["result"][0]["isStable"] is False
    assert call("getActiveStakePoolDelegationByEpoch", 5)["result"][0]["lovelace"] == 10**20
    assert call("getNonceByEpoch", 3)["result"]["nonce"] == "pool" and call("getNonceByEpoch", 4)["result"]["nonce"] is None
    assert call("getCurrentSyncedBlock")["result"] == {"blockNo": 3, "blockTimestamp": 186, "blockHeaderHash": "b9", "slotNo": 9, "epochNo": 1, "nodeTip": {"blockNo": 5}}
    assert call("getAddressCount", "addr")["result"] == 2
    short = Api(ingest, [], api.extra, short=True)
    assert short.nonce(4) is None and "epochNo" not in short.stake(5)[0]
    codes = [json.loads(api.call("{"))["error"]["code"], json.loads(api.call("[]"))["error"]["code"], call("no")["error"]["code"]]
    assert codes == [-32700, -32600, -32601]
    bad = [("getUtxosFromAddress", {}), ("getUtxosFromAddress", {"address": "other"}), ("getUtxosFromAddress", {"address": "addr", "createdAtOrAfterSlotNo": 3}), ("getNonceByEpoch", "x"), ("getBurnTokenEvents", {"policyId": "p", "createdAfterTx": "none"})]
    assert {call(*b)["error"]["code"] for b in bad} == {-32602}
    pages, token = [], None
    for _ in range(2):
        answer = call("getUtxosFromAddress", {"address": "addr", "pageSize": 1} | ({"page": token} if token else {}))["result"]
        pages, token = pages + answer["rows"], answer["next"]
    assert pages == found and token is None
    assert call("getBurnTokenEvents", {"policyId": "p", "pageSize": 5})["result"] == {"rows": burn, "next": None}
    assert {call("getUtxosFromAddress", {"address": "addr", **x})["error"]["code"] for x in ({"pageSize": 0}, {"pageSize": 2, "page": "?"}, {"pageSize": 2, "page": 5})} == {-32602}
    monkeypatch.setattr(rpc, "MOST", 1)
    assert "pageSize" in call("getUtxosFromAddress", {"address": "addr"})["error"]["message"]
    server = serve(api, 0, lambda: "m 1\n", {"depth": 1})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{at}/addresses")) == ["addr", "addr2"]
    assert urllib.request.urlopen(f"{at}/metrics").read() == b"m 1\n"
    assert json.load(urllib.request.urlopen(f"{at}/json-rpc", b'{"jsonrpc":"2.0","id":2,"method":"echo","params":3}'))["result"] == 3
    server.shutdown()


def test_a_batch_that_runs_again_changes_nothing(ingested, spark):
    ingest, _ = ingested
    before = ingest.table("utxo").count()
    ingest.process(spark.createDataFrame(rows()[3:], schemas.STREAM), 2, next(iter(ingest.state().sources)))
    assert ingest.table("utxo").count() == before


def test_rollback_behind_what_is_stable(ingested, spark):
    ingest, _ = ingested
    with pytest.raises(errors.ResumingFailed):
        ingest.process(spark.createDataFrame([(9, "ROLLBACK", 1, None)], schemas.STREAM), 50)
    with pytest.raises(errors.StopIngest):
        ingest.process(spark.createDataFrame([(9, "STOP", None, None)], schemas.STREAM), 51)
    assert ingest.point() == (9, 7)


def test_a_block_that_comes_back_in_one_batch(spark, tmp_path):
    """Indexed, rolled back and indexed again with the same hash: its rows are there once."""
    one, two = block(1, 1, 2, [tx("t1", [output("a", 1)])]), block(2, 2, 2, [tx("t2", [output("a", 1)], [("t1", 0)], witness_datums={"h": "w"}, mint=[MINT])])
    log = [(0, "INDEX", None, one), (1, "INDEX", None, two), (2, "ROLLBACK", 1, None), (3, "INDEX", None, two)]
    other = Ingest(spark, str(tmp_path / "tables"), settings=Settings(depth=2))
    other.process(spark.createDataFrame(log, schemas.STREAM), 0)
    assert {t.name: other.table(t.name).count() for t in other.tables} == {"block_info": 2, "utxo": 2, "spent": 1, "datum": 1, "mint": 1}
    assert sorted(r.slot_no for r in other.table("block_info").collect()) == [1, 2] == sorted(r.slot_no for r in other.positions().collect())


def test_random_chains_in_batches(spark, tmp_path):
    """However the log is cut into batches, the tables hold what a plain model keeps."""
    log = items(5, 120, depth=6)
    blocks = {seq: block(slot, slot, slot + 1, []) for seq, op, slot, _ in log if op == "INDEX"}
    rows_ = [(seq, op, to, blocks.get(seq)) for seq, op, slot, to in log]
    ingest = Ingest(spark, str(tmp_path / "tables"), TABLES[:1], Settings(depth=40))
    for i, at in enumerate(range(0, 120, 30)):
        ingest.process(spark.createDataFrame(rows_[at : at + 30], schemas.STREAM), i)
        chain_ = model(log[: at + 30])
        assert sorted(r.seq for r in ingest.positions().collect()) == [s for s, _ in chain_]
        assert ingest.point()[0] == chain_[-1][1]


def test_hot_cold_and_pruning(spark, tmp_path):
    ingest = Ingest(spark, str(tmp_path / "tables"), settings=Settings(depth=2, flush_every=3))
    for i, part in enumerate((rows()[:1], rows()[1:3], rows()[3:])):
        ingest.process(spark.createDataFrame(part, schemas.STREAM), i)
    state = ingest.state()
    assert len(state.hot) == 1 and [(r.low, r.high) for r in state.cold] == [(2, 7)]
    hot, cold = ingest.hot_and_cold("block_info")
    assert [r.slot_no for r in hot.collect()] == [9] and sorted(r.slot_no for r in cold.collect()) == [2, 7]
    with pytest.raises(ValueError):
        ingest.prune(9)
    ingest.prune(2)
    assert sorted(r.slot_no for r in ingest.table("block_info").collect()) == [7, 9]
    with pytest.raises(errors.NotStoredAnymore):
        ingest.table("utxo", as_of=1)
    assert ingest.table("block_info", as_of=7).count() == 1
    again = Ingest(spark, ingest.root, settings=Settings(depth=2))
    assert again.state() == ingest.state() and again.point() == (9, 7)
    ingest.prune(7)
    assert ingest.state().cold == [] and [r.slot_no for r in ingest.table("block_info").collect()] == [9]
    with pytest.raises(errors.IngestError):
        again.process(spark.createDataFrame([(9, "ROLLBACK", 1, None)], schemas.STREAM), 3)


def chain_of(slots, outputs=0, depth_of=lambda slot: slot, fork="a"):
    """Blocks of one slot each, with a transaction if there are outputs."""
    made = lambda s: [tx(f"t{s}", [output(f"addr{(s * 7 + i) % 50}", s + i) for i in range(outputs)])] if outputs else []
    return [(s, "INDEX", None, block(s, s, depth_of(s), made(s), fork)) for s in slots]


def test_the_same_log_again_after_a_restart(spark, tmp_path):
    """What was not final is dropped and comes again with the same numbers; nothing is lost and nothing is there twice."""
    seen = lambda i: sorted((r.slot_no, r.block_hash) for r in i.table("block_info").collect())
    ingest = Ingest(spark, str(tmp_path / "tables"), TABLES[:2], Settings(depth=2))
    ingest.process(spark.createDataFrame(chain_of(range(1, 8), 1), schemas.STREAM), 0, "first")
    again = Ingest(spark, ingest.root, TABLES[:2], Settings(depth=2))
    assert again.reopen() == 4 and [s for s, _ in seen(again)] == [1, 2, 3, 4] and again.state().incarnation == 1
    again.process(spark.createDataFrame(chain_of(range(5, 9), 1), schemas.STREAM), 0, "second")
    assert [s for s, _ in seen(again)] == list(range(1, 9)) and again.table("utxo").count() == 8
    # the whole log, with a fork that was rolled back to before what is final now
    whole = chain_of(range(1, 6), 1) + [(6, "ROLLBACK", 3, None)] + [(s + 3, "INDEX", None, block(s, s, s, [], "c")) for s in range(4, 10)]
    third = Ingest(spark, ingest.root, TABLES[:2], Settings(depth=2))
    assert third.reopen() == 5
    third.process(spark.createDataFrame(whole, schemas.STREAM), 0, "third")
    assert seen(third) == [(s, f"a{s}") for s in range(1, 6)] + [(s, f"c{s}") for s in range(6, 10)]
    # new rows are judged strictly
    with pytest.raises(errors.ResumingFailed):
        third.process(spark.createDataFrame([(50, "ROLLBACK", 2, None)], schemas.STREAM), 1, "third")


def test_files_stay_few(spark, tmp_path):
    """Hot rows are flushed and runs merged, so files follow the logarithm of the batches; rows are those of a plain model."""
    top = tmp_path / "tables"
    settings = Settings(depth=3, flush_every=2, merge=2, file_rows=20)
    ingest = Ingest(spark, str(top), TABLES[:2], settings)
    log, most = [], 0
    for i in range(14):
        log += chain_of([i + 1], 2) if i % 7 != 3 else [(i + 1, "ROLLBACK", i - 1, None)]
        ingest.process(spark.createDataFrame(log[-1:], schemas.STREAM), i)
        most = max(most, len(ingest.state().cold) + len(ingest.state().hot))
    expected = [s for _, s in model([(seq, op, b and b["slot_no"], to) for seq, op, to, b in log])]
    assert sorted(r.slot_no for r in ingest.table("block_info").collect()) == expected == sorted(r.slot_no for r in ingest.positions().collect())
    assert sorted(r.slot_no for r in ingest.table("utxo").collect()) == sorted(2 * expected)
    assert most <= 3 + 5 and len(list(top.glob("_state/*"))) == 2
    state = ingest.state()
    named = {*state.hot, *(r.name for r in state.cold)} | {part for g in state.gone for part in g.replace("segment=", "").split("/")}
    assert {p.relative_to(top).parts[1].removeprefix("segment=") for p in top.glob("block_info/**/*.parquet")} <= named
    assert ingest.lookup("utxo", "addr7").count() == ingest.table("utxo").where("address = 'addr7'").count() > 0
    assert ingest.lookup("utxo", "addr7", 5, 15).count() == ingest.table("utxo").where("address = 'addr7' and slot_no between 5 and 15").count()
    assert all(ingest.of_transaction("utxo", f"t{s}").count() == 2 * (s in expected) for s in (1, 4, 9, 14))


def test_lookups_read_few_files(spark, tmp_path, monkeypatch):
    ingest = Ingest(spark, str(tmp_path / "tables"), TABLES[:2], Settings(depth=1, flush_every=1, merge=2, file_rows=30))
    for i in range(2):
        ingest.process(spark.createDataFrame(chain_of(range(i * 150 + 1, i * 150 + 151), 14), schemas.STREAM), i)
    (run,) = ingest.state().cold
    laid = len(list((tmp_path / "tables" / "utxo" / f"segment={run.name}").glob("**/*.parquet")))
    assert laid > 120 and run.level == 1
    chosen = []
    for name in ("files_of_key", "files_of_value"):
        real = getattr(layout, name)
        monkeypatch.setattr(layout, name, lambda *a, f=real: chosen.append(f(*a)) or chosen[-1])
    every = ingest.table("utxo")
    assert ingest.lookup("utxo", "addr9", 100, 140).count() == every.where("address = 'addr9' and slot_no between 100 and 140").count() > 0
    assert ingest.of_transaction("utxo", "t250").count() == 14
    assert ingest.of_transaction("utxo", "no such").isEmpty()
    # the transaction's 14 outputs have 14 addresses, so that many files hold it
    by_key, by_filter, by_none = map(len, chosen)
    assert by_key < 0.05 * laid and by_filter <= 15 and by_none < 0.05 * laid


def test_pages_of_a_large_answer(spark, tmp_path):
    """Pages add up to the whole answer, also when blocks arrive between them."""
    ingest = Ingest(spark, str(tmp_path / "tables"), settings=Settings(depth=1, flush_every=2))
    many = lambda slots: [(s, "INDEX", None, block(s, s, s, [tx(f"t{s}", [output("addr", i) for i in range(40)])])) for s in slots]
    ingest.process(spark.createDataFrame(many(range(1, 6)), schemas.STREAM), 0)
    api, seen, token = Api(ingest), [], None
    while token is not None or not seen:
        page = api.utxos({"address": "addr", "pageSize": 90} | ({"page": token} if token else {}))
        seen, token = seen + [(r["slotNo"], r["txIx"]) for r in page["rows"]], page["next"]
        if len(seen) == 90:
            ingest.process(spark.createDataFrame(many([9]), schemas.STREAM), 1)
    assert seen == [(s, i) for s in range(1, 6) for i in range(40)]


def test_actions_run_again_after_a_loss(spark, tmp_path):
    seen = []

    def fails(blocks):
        seen.append(sorted(r.slot_no for r in blocks.collect()))
        if len(seen) == 1:
            raise RuntimeError("lost")

    part = spark.createDataFrame(chain_of([1, 2]), schemas.STREAM)
    ingest = Ingest(spark, str(tmp_path / "tables"), TABLES[:1], Settings(depth=1, actions=(fails,)))
    with pytest.raises(RuntimeError):
        ingest.process(part, 0, "s")
    again = Ingest(spark, ingest.root, TABLES[:1], Settings(depth=1, actions=(fails,)))
    again.process(part, 0, "s")
    again.process(part, 0, "s")
    assert seen == [[1, 2], [1, 2]] and again.table("block_info").count() == 2


def test_epochs_show_once_they_are_final(spark, tmp_path):
    """Parts of blocks add up per epoch, in whatever batches they come; an epoch waits for a final block beyond it."""
    tables = (*TABLES[:1], *epoch_tables("right(o.address, 1)", "o.value['']['']"))
    ingest = Ingest(spark, str(tmp_path / "tables"), tables, Settings(depth=2, flush_every=2, merge=2, file_rows=5))
    rows_ = chain_of(range(1, 9), 2) + [(9, "ROLLBACK", 6, None)] + [(s + 3, "INDEX", None, r) for s, _, _, r in chain_of(range(7, 18), 3, fork="b")]
    for i, at in enumerate(range(0, len(rows_), 3)):
        ingest.process(spark.createDataFrame(rows_[at : at + 3], schemas.STREAM), i)
    sums = {}
    for s in [*range(1, 7), *range(7, 15)]:
        for o in range(2 if s < 7 else 3):
            key = (s // 5, str((s * 7 + o) % 50)[-1])
            sums[key] = sums.get(key, 0) + s + o
    assert ingest.state().stable == 14 and ingest.state().epoch == 2
    assert {(r.epoch_no, r.pool_id): int(r.lovelace) for r in ingest.table("epoch_sdd").collect()} == {k: v for k, v in sums.items() if k[0] < 2}
    assert sorted((r.epoch_no, r.slot_no, r.block_hash) for r in ingest.table("epoch_nonce").collect()) == [(0, 1, "a1"), (1, 5, "a5")]


def test_reopen_and_reset(spark, tmp_path):
    """A restart goes back to what is final, and a new source sends what comes after."""
    ingest = Ingest(spark, str(tmp_path / "tables"), settings=Settings(depth=2))
    ingest.process(spark.createDataFrame(rows(), schemas.STREAM), 0, "first")
    again = Ingest(spark, ingest.root, settings=Settings(depth=2))
    assert again.reopen() == 7 and again.point() == (7, 7)
    assert sorted(r.slot_no for r in again.table("block_info").collect()) == [2, 7]
    more = [(20, "INDEX", None, block(8, 3, 5, [], "c")), (21, "INDEX", None, block(12, 4, 6, [], "c"))]
    again.process(spark.createDataFrame(more, schemas.STREAM), 0, "second")
    assert sorted((r.slot_no, r.block_hash) for r in again.table("block_info").collect()) == [(2, "a2"), (7, "b7"), (8, "c8"), (12, "c12")]
    again.reset()
    assert again.point() == (None, None) and again.table("utxo").isEmpty()
    again.process(spark.createDataFrame(rows(), schemas.STREAM), 0, "first")
    assert again.point() == (9, 7) and again.table("block_info").count() == 3


def test_actions_and_statistics(spark, tmp_path):
    seen: list[int] = []
    files = str(tmp_path / "seen")

    def touch(r) -> None:
        with open(f"{files}-{r.slot_no}", "w"):
            pass

    s = stats.SyncStats()
    settings = Settings(depth=2, actions=(lambda blocks: seen.append(blocks.count()), for_each(touch)), stats=s, prune_every=5)
    ingest = Ingest(spark, str(tmp_path / "tables"), settings=settings)
    ingest.process(spark.createDataFrame(rows(), schemas.STREAM), 0)
    assert seen == [4] and {p.name for p in tmp_path.glob("seen-*")} == {"seen-2", "seen-6", "seen-7", "seen-9"}
    assert s.total == {"blocks": 4, "rollbacks": 1} and s.report()["percent"] == 60
    assert ingest.state().pruned == 7


def test_batch_equals_stream(ingested, spark, tmp_path):
    """Replaying the whole log in one batch gives the same tables."""
    other = Ingest(spark, str(tmp_path / "tables"), settings=Settings(depth=2))
    other.process(spark.createDataFrame(rows(), schemas.STREAM), 0)
    for t in other.tables:
        assert sorted(map(str, other.table(t.name).collect())) == sorted(map(str, ingested[0].table(t.name).collect()))


def test_tracked_tables(spark, tmp_path):
    tables = configured(["addr"], [("p", "other")], scripts=False)
    other = Ingest(spark, str(tmp_path / "tables"), tables, Settings(depth=2))
    other.process(spark.createDataFrame(rows(), schemas.STREAM), 0)
    assert {r.address for r in other.table("utxo").collect()} == {"addr"}
    assert other.table("mint").isEmpty() and not other.table("spent").isEmpty()


def test_command_line(spark, tmp_path):
    write(spark, str(tmp_path / "log"), [rows()])
    args = cli.parser().parse_args(["--log", f"{tmp_path}/log/*", "--tables", f"{tmp_path}/tables", "--address", "addr", "--asset", "p.t", "--depth", "2", "--start", "2:a2"])
    assert cli.start_point(args.start) == (2, "a2") and cli.start_point("genesis") == (None, None) and cli.block_range("2-5") == (2, 5) and cli.asset("p") == ("p", None) == cli.asset("p.")
    ingest = cli.run(spark, args)
    assert {r.slot_no for r in ingest.table("block_info").collect()} == {7, 9}
    assert "blocks_total 3" in stats.metrics_text(ingest.settings.stats)
    with pytest.raises(errors.NoIntersection):
        cli.run(spark, cli.parser().parse_args(["--log", f"{tmp_path}/log/*", "--tables", f"{tmp_path}/none", "--start", "6:a6"]))
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--log", "x"])


def test_event_files(spark, tmp_path):
    for name in ("block_just_10_200_ab.cbor", "block_nothing_9_190_.cbor", "other_just_1_2_cd.cbor"):
        (tmp_path / name).write_bytes(name.encode())
    found = source.event_files(spark, str(tmp_path), "block").collect()
    assert [(r.block_no, r.slot_no, r.block_hash, r.has_event) for r in found] == [(9, 190, "", False), (10, 200, "ab", True)]
    (tmp_path / "block_bad.cbor").write_bytes(b"x")
    with pytest.raises(Exception, match="bad event file name"):
        source.event_files(spark, str(tmp_path), "block").collect()


def test_event_store(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    event_store.write_events(spark.createDataFrame([(i, i * 10, f"a{i}", b"x" * i if i % 2 else None) for i in range(1, 9)], "block_no bigint, slot_no bigint, block_hash string, content binary"), folder, "block")
    slots = lambda: [(r.slot_no, r.has_event, len(r.content or b"")) for r in source.event_files(spark, folder, "block").collect()]
    assert slots() == [(i * 10, i % 2 == 1, i * (i % 2)) for i in range(1, 9)]
    assert event_store.resumed(spark, folder, "block", 60).count() == 6
    event_store.keep_newest(source.event_files(spark, folder, "block"), 2, 50)
    assert [s for s, *_ in slots()] == [40, 50, 60]
    event_store.roll_back(source.event_files(spark, folder, "block"), None)
    assert slots() == []


def test_block_ranges(spark, tmp_path):
    log = spark.createDataFrame(rows(), schemas.STREAM)
    event_store.write_range(log, 2, 3, str(tmp_path / "r"))
    read = lambda name: sorted(r.block_hash for r in spark.read.parquet(str(tmp_path / "r" / name)).collect())
    assert read("blocks") == ["b7", "b9"] and read("before") == ["a2"]


def test_intersection(spark, tmp_path, monkeypatch):
    """As a plain model says, for any list of points, whatever is appended later; only some segments are read."""
    log, every = items(21, 400, depth=12), 25
    rows_ = [(seq, op, to, block(slot, slot, slot, [], f"h{seq}-") if op == "INDEX" else None) for seq, op, slot, to in log]
    rng, read = random.Random(3), []
    real = source._in_segments
    monkeypatch.setattr(source, "_in_segments", lambda log, segments, every: read.append(len(segments)) or real(log, segments, every))
    for at in (130, 400):
        frame = spark.createDataFrame(rows_[:at], schemas.STREAM).coalesce(2)
        index = source.write_index(frame, str(tmp_path / "index"), every)
        assert index.count() == -(-at // every)
        valid = {(slot, f"h{seq}-{slot}") for seq, slot in model(log[:at])}
        every_block = [(slot, f"h{seq}-{slot}") for seq, op, slot, _ in log[:at] if op == "INDEX"]
        for n in (1, 5, 40):
            points = rng.sample(every_block, n) + [(5000, "unknown")]
            expected = max((p for p in points if p in valid), default=None)
            if expected is None:
                assert source.newest_common(frame, index, [*points, (None, None)], every) == (None, None)
                with pytest.raises(errors.NoIntersection):
                    source.newest_common(frame, index, points, every)
            else:
                assert source.newest_common(frame, index, points, every) == expected
    known = max(valid)
    read.clear()
    assert source.newest_common(frame, index, [known, min(valid)], every) == known and sum(read) <= 4


def test_eras(spark):
    eras = spark.createDataFrame([(0, 0, 1000, 10, 20), (100, 10, 3000, 50, 1)], "first_slot bigint, first_epoch bigint, first_time bigint, epoch_slots bigint, slot_seconds bigint")
    out = source.with_epoch_and_time(spark.createDataFrame([(5,), (99,), (100,), (210,)], "slot_no bigint"), eras)
    assert sorted(tuple(r) for r in out.collect()) == [(5, 0, 1100), (99, 9, 2980), (100, 10, 3000), (210, 12, 3110)]


def test_chain_source(spark, tmp_path):
    lines = [{"seq": i, "op": "INDEX", "slot_no": i, "block_no": i} for i in range(5)] + [{"seq": 5, "op": "ROLLBACK", "to_slot": 3}]
    (tmp_path / "0.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    spark.dataSource.register(source.ChainSource)
    stream = spark.readStream.format("chain").option("startingLine", 2).option("window", 2).load(str(tmp_path))
    query = stream.writeStream.format("memory").queryName("chain_rows").trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    (tmp_path / "1.jsonl").write_text(json.dumps({"seq": 6, "op": "INDEX", "slot_no": 4, "block_no": 4}) + "\n{")  # the last line is not whole yet
    query.processAllAvailable()
    query.stop()
    assert sorted(r.seq for r in spark.table("chain_rows").collect()) == [2, 3, 4, 5, 6]
    assert source.forward_only(spark.table("chain_rows")).count() == 4


def test_retries():
    waits, tries = [], iter([ConnectionError, ConnectionError, None])

    def action():
        e = next(tries)
        if e:
            raise e
        return "done"

    assert source.retried(action, 1, 10, waits.append) == "done" and waits == [1, 2]
    with pytest.raises(ConnectionError):
        source.retried(lambda: (_ for _ in ()).throw(ConnectionError()), 1, 3, waits.append)


def test_stats():
    now, seen = iter([0.0, 2.0, 2.0]), []
    s = stats.SyncStats(seen.append, clock=lambda: next(now))
    s.seen(10, 1, 50, 100)
    out = s.report()
    assert out["blocks_per_second"] == 5 and out["percent"] == 50 and seen == [out] and s.blocks == 0
    assert "50.00 %" in stats.line(out) and "Almost" in stats.line(out | {"percent": 99.996}) and "Synced" in stats.line(out | {"percent": 100.0})
    assert "tidemark_blocks_total 10" in stats.metrics_text(s) and stats.percent(None, 5) == 0


def test_result_cache(spark):
    asked = []

    def query(key, as_of):
        asked.append((key, as_of))
        return spark.range(as_of)

    cache = ResultCache(query, lambda old, key, a, b: old.union(spark.range(a, b)))
    cache.advanced(3)
    assert cache.get("k", 3).count() == 3 and cache.get("k", None).count() == 3 and asked == [("k", 3)]
    cache.advanced(5)
    assert cache.get("k", 5).count() == 5 and len(asked) == 1
    assert cache.get("k", 2).count() == 2 and asked[-1] == ("k", 2)
    with pytest.raises(errors.AheadOfLastSync):
        cache.get("k", 9)
    cache.rolled_back(4)
    assert cache.get("k", 4).count() == 4 and asked[-1] == ("k", 4)


