from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.chain import items, model
from tidemark import errors
from tidemark.functions import addresses, datum, render
from tidemark.operators import changelog, generic, intervals, ordered, preprocess
from tidemark.plans import domain

LOG = "seq bigint, op string, slot_no bigint, to_slot bigint"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_scans_as_plain_loops(spark, buckets):
    rng = random.Random(1)
    rows = [(i * rng.choice([1, 1, 7]) + 1000 * (i // 20), rng.choice([None, *range(9)])) for i in range(120)]
    rows = sorted({k: v for k, v in rows}.items())
    frame = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5)
    total, sums = None, {}
    for k, v in rows:
        total = v if total is None else total if v is None else total + v
        sums[k] = total
    assert dict(ordered.running_sum(frame, "k", F.col("v"), "s", buckets=buckets).select("k", "s").collect()) == sums
    least = {k: min((w for _, w in rows[i + 1 :] if w is not None), default=None) for i, (k, _) in enumerate(rows)}
    assert dict(ordered.suffix_min(frame, "k", F.col("v"), "m", buckets=buckets).select("k", "m").collect()) == least
    before = {k: rows[i - 1][1] if i else None for i, (k, _) in enumerate(rows)}
    assert dict(ordered.previous(frame, "k", F.col("v"), "p", buckets=buckets).select("k", "p").collect()) == before


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "k bigint, v bigint")
    assert ordered.running_sum(empty, "k", F.col("v"), "s").collect() == []


def test_no_task_gets_the_whole_log(spark):
    """The only window without a partition runs over the buckets' sums."""
    plan = ordered.running_sum(spark.range(1000).selectExpr("id k", "id v"), "k", F.col("v"), "s", buckets=10)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "_bucket" not in line:
            raise AssertionError(line)


def test_laws_on_random_chains(spark):
    """200 chains at once: valid rows as the model has them, and the laws of rollbacks."""
    rows = [(chain * 10_000 + s, op, None if slot is None else chain * 10_000 + slot, None if to is None else chain * 10_000 + to) for chain in range(200) for s, op, slot, to in items(chain, 60)]
    # chains lie one after another in one log: a rollback of a later chain never reaches an earlier one
    expected = sorted((chain * 10_000 + s, chain * 10_000 + slot) for chain in range(200) for s, slot in model(items(chain, 60)))
    frame = log(spark, rows)
    for buckets in (1, 37):
        assert sorted(tuple(r) for r in changelog.valid_rows(frame, buckets).select("seq", "slot_no").collect()) == expected
    last = max(slot for _, slot in expected)
    valid = changelog.valid_rows(frame)
    assert changelog.rolled_back(valid, last).count() == valid.count()
    once = changelog.rolled_back(valid, last - 20)
    assert sorted(once.collect()) == sorted(changelog.rolled_back(once, last - 20).collect())
    assert changelog.rolled_back(valid, None).isEmpty()
    again = log(spark, [*rows, (3_000_000, "ROLLBACK", None, last - 20), (3_000_001, "INDEX", last - 19, None)])
    assert changelog.valid_rows(again).where("seq < 3000000").count() == once.count()


def test_stability(spark):
    rows = spark.createDataFrame([(i, i, 20) for i in range(1, 21)], "slot_no bigint, block_no bigint, tip_block_no bigint")
    assert changelog.stable_point(rows, 5).first()[0] == 14
    assert changelog.stable_point(rows, 50).first()[0] is None
    assert {r.slot_no for r in changelog.with_stability(rows, 14).where("is_stable").collect()} == set(range(1, 15))
    assert changelog.with_stability(rows, None).where("is_stable").isEmpty()
    assert changelog.distance(rows).agg(F.max("distance")).first()[0] == 19


def test_resume(spark):
    frame = log(spark, [(0, "INDEX", 1, None), (1, "INDEX", 5, None), (2, "ROLLBACK", None, 1), (3, "INDEX", 6, None)])
    assert [r.seq for r in changelog.resumed(frame, 4).orderBy("seq").collect()] == [1, 3]
    changelog.check_rollbacks(frame, 1)
    with pytest.raises(errors.ResumingFailed):
        changelog.check_rollbacks(frame, 4)


def test_ahead_of_sync(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "slot_no bigint, v string")
    with pytest.raises(errors.AheadOfLastSync) as e:
        generic.synced_only(lambda: rows, 9, 2, partial=True)
    assert e.value.partial.count() == 3
    assert generic.synced_only(lambda: rows, 2, 2).count() == 3
    assert generic.last_event(rows.where("v = 'a'"), "v").first() == (1, "a")
    hot, cold = generic.hot_and_cold(rows, 1)
    assert sorted(generic.appended(hot, cold).collect()) == sorted(rows.collect())
    assert generic.latest_events(rows, 2, None, "v").collect() == [(2, "b"), (2, "c")]
    assert generic.regrouped(rows, "v").where("slot_no = 2").first().events == [("b",), ("c",)]


def test_consistent_point_is_the_minimum(spark):
    progress = spark.createDataFrame([(0, 1, "a", 5, 2), (0, 2, "a", 9, 4), (0, 2, "b", 7, 3)], "generation bigint, batch_id bigint, table_name string, last_sync bigint, last_stable bigint")
    assert tuple(generic.consistent_point(progress).first()) == (7, 3)
    assert tuple(generic.consistent_point(progress, "a").first()) == (9, 4)


def test_preprocessing(spark):
    rows = spark.createDataFrame([(i, i, i // 4, i % 3, f"n{i % 2}") for i in range(1, 13)], "slot_no bigint, block_no bigint, epoch_no bigint, policy_id bigint, asset_name string")
    slots = lambda f: sorted(r.slot_no for r in f.collect())
    assert slots(preprocess.first_of_epoch(rows)) == [1, 4, 8, 12]
    assert slots(preprocess.delayed(rows, 3)) == list(range(1, 10))
    assert slots(preprocess.delayed(rows, 0)) == list(range(1, 13))
    assert slots(preprocess.delayed(rows, 99)) == []
    assert slots(preprocess.keep_last(rows, 2)) == [11, 12]
    assert slots(preprocess.keep_last(rows, 1, "policy_id")) == [10, 11, 12]
    assert slots(preprocess.tracked_assets(rows, [(0, None), (1, "n0")])) == [3, 4, 6, 9, 10, 12]
    assert slots(preprocess.tracked_assets(rows, [])) == []
    assert slots(preprocess.tracked_addresses(rows, [], "policy_id")) == list(range(1, 13))
    assert slots(preprocess.just_before_range(rows, 5)) == [4]
    with pytest.raises(errors.SlotBoundsInvalid):
        preprocess.in_block_range(rows, 0, 3)
    with pytest.raises(errors.RollbackBehindHistory):
        preprocess.check_pruned(10, 5)
    preprocess.check_pruned(10, 10)
    preprocess.check_pruned(None, None)


def test_asset_bounds(spark):
    rows = spark.createDataFrame([(1, 1, 7, 0, 3, "x", -1), (2, 2, 8, 0, 3, "x", 0), (3, 3, 9, 0, 3, "y", -4), (4, 4, 10, 0, 3, "x", 5)], "slot_no bigint, block_no bigint, tx_id bigint, tx_index bigint, policy_id bigint, asset_name string, quantity bigint")
    ids = lambda f: [r.tx_id for r in f.collect()]
    assert ids(domain.asset_events(rows, 3)) == [7, 8, 9, 10]
    assert ids(domain.asset_events(rows, 3, kind="burn")) == [7, 9] and ids(domain.asset_events(rows, 3, kind="mint")) == [10]
    assert ids(domain.asset_events(rows, 3, lower_tx=8, upper=3, as_of=4)) == [8, 9]  # the bound's own slot is included
    for bad in ({"lower_tx": 99}, {"lower_tx": 10, "upper": 3, "as_of": 4}, {"upper": 9, "as_of": 4}, {"upper": 1}):
        with pytest.raises(errors.SlotBoundsInvalid):
            domain.asset_events(rows, 3, **bad)
    tagged = domain.with_depth_stability(rows, rows, 4, 2)
    assert [r.is_stable for r in tagged.orderBy("slot_no").collect()] == [True, True, False, False]
    with pytest.raises(errors.SlotBoundsInvalid):
        domain.with_depth_stability(rows, rows, 99, 2)


def test_unspent_edges(spark):
    utxo = spark.createDataFrame([("a", 0, 5), ("b", 0, 6), ("c", 0, 9)], "tx_id string, tx_ix int, slot_no bigint")
    spent = spark.createDataFrame([("a", 0, 8)], "tx_id string, tx_ix int, slot_no bigint")
    ids = lambda f: sorted(r.tx_id for r in f.collect())
    assert ids(domain.unspent(utxo, spent, 7)) == ["a", "b"]
    assert ids(domain.unspent(utxo, spent, 8)) == ["b"]  # spent at the bound is gone
    assert ids(domain.unspent(utxo, spent, 9)) == ["b", "c"]  # created at the bound is there
    assert ids(domain.unspent(utxo, spent, 9, 9)) == ["c"]
    assert ids(domain.unspent(utxo, spent, None)) == ["b", "c"]


def test_rendering(spark):
    row = spark.sql("select array(named_struct('tx_id', 'a', 'tx_ix', 1), named_struct('tx_id', 'b', 'tx_ix', 0)) refs, map('p', map('z', 2, 'a', 1), '', map('', 5)) value, X'0AFF' raw")
    got = row.select(render.references("refs").alias("r"), render.parse_references(render.references("refs")).alias("p"), render.value_json("value").alias("v"), render.lower_hex("raw").alias("h")).first()
    assert (got.r, [tuple(x) for x in got.p], got.v, got.h) == ("a#1,b#0", [("a", 1), ("b", 0)], '{"":{"":5},"p":{"a":1,"z":2}}', "0aff")


def test_addresses(spark):
    assert addresses.decode("A12UEL5L") == ("a", b"")  # from the published test vectors
    assert addresses.decode("abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxw")[0] == "abcdef"
    for bad in (None, "", "A1G7SGD8", "a12UEL5L", "10a06t8", "1qzzfhee", "x1b4n0q5v", "abc1rzg"):
        assert addresses.decode(bad) is None
    raw = [bytes(range(n)) for n in (1, 20, 29, 57)]
    frame = spark.createDataFrame([(b,) for b in raw] + [(None,)], "raw binary")
    text = frame.select("raw", addresses.encoder("addr")("raw").alias("text"))
    back = text.select("raw", "text", addresses.decoder()("text").alias("back")).collect()
    assert all(r.raw == r.back and (r.text is None or r.text.startswith("addr1")) for r in back) and len(back) == 5


def test_buckets_hold_like_numbers_of_rows(spark):
    """One far outlier, a dense stretch, repeated values and nulls."""
    values = [10**12, None, None, *range(1000), *[500] * 50]
    out = ordered.bucketed(spark.createDataFrame([(v,) for v in values], "x long"), "x", 8)
    rows = sorted((r._bucket, -1 if r.x is None else r.x) for r in out.collect())
    assert [x for _, x in rows] == sorted(-1 if v is None else v for v in values)
    assert max(Counter(b for b, _ in rows).values()) < 260 and {b for b, x in rows if x == -1} == {-1}
    assert len({b for b, x in rows if x == 500}) == 1


def test_folds_and_control_rows(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([3, None, 5, 1, 9])], "slot_no long, v int")
    assert [r.most for r in preprocess.fold(rows, F.max, F.col("v"), F.greatest, "most").orderBy("slot_no").collect()] == [3, 3, 5, 5, 9]
    log = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, k string")
    steps = F.when(F.col("k") == "b", F.array(F.struct("k"), F.struct(F.lit("stop").alias("k")))).otherwise(F.array(F.struct("k")))
    assert sorted(map(tuple, preprocess.expanded(log, steps, 2).collect())) == [(2, "a"), (4, "b"), (5, "stop")]


def test_datum_json(spark):
    frame = spark.createDataFrame([('{ "constructor":0, "fields":[{"int": 1},{"bytes":"00ff"}]}',), ("no json",), (None,)], "d string")
    assert [r[0] for r in frame.select(render.datum_json("d")).collect()] == ['{"constructor":0,"fields":[{"int":1},{"bytes":"00ff"}]}', None, None]


@pytest.mark.parametrize("seed", range(3))
def test_stabbing_as_brute_force(spark, seed):
    """Open, empty and unbounded intervals, points without any, and points that are asked twice."""
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), s := rng.randint(-20, 60), rng.choice([None, s, s + 1, s + rng.randint(0, 90)]), i) for i in range(150)]
    points = [(i, rng.choice("abcd"), rng.randint(-30, 70)) for i in range(60)] + [(60, "a", None), (61, "b", 10), (62, "b", 10)]
    lives = spark.createDataFrame(rows, "k string, born long, died long, i long")
    asked = spark.createDataFrame(points, "q long, k string, at long")
    holds = lambda r, k, at: r[0] == k and at is not None and r[1] <= at and (r[2] is None or at < r[2])
    found = intervals.stabbed(lives, asked, ["k"], "born", "died", "at").select("q", "i").collect()
    assert sorted(map(tuple, found)) == sorted((q, r[3]) for q, k, at in points for r in rows if holds(r, k, at))
    sums = intervals.stabbed_sums(lives, asked, ["k"], "born", "died", "at", n=F.lit(1), total=F.col("i")).select("q", "n", "total").collect()
    assert sorted(map(tuple, sums)) == sorted((q, len(x), sum(r[3] for r in x)) for q, k, at in points for x in [[r for r in rows if holds(r, k, at)]])


def test_stabbing_nothing(spark):
    lives = spark.createDataFrame([("a", 1, 5)], "k string, born long, died long")
    none = spark.createDataFrame([], "k string, at long")
    assert intervals.stabbed(lives, none, ["k"], "born", "died", "at").isEmpty()
    assert intervals.stabbed(lives.limit(0), spark.createDataFrame([("a", 3)], "k string, at long"), ["k"], "born", "died", "at").isEmpty()


GOOD = ['{"int": 5}', '{"int":-123456789012345678901234567}', '{"bytes":""}', '{"bytes":"00ff"}', '{"list":[]}', '{"map":[]}', '{"fields":[],"constructor":0}', '{"map":[{"v":{"int":1},"k":{"list":[{"map":[{"k":{"int":0},"v":{"bytes":"aa"}}]}]}}]}']
BAD = {"{": datum.NOT_JSON, "null": datum.UNKNOWN, "[1]": datum.UNKNOWN, "{}": datum.UNKNOWN, '{"int":1,"bytes":""}': datum.UNKNOWN, '{"int":1.5}': datum.NOT_WHOLE, '{"int":"1"}': datum.NOT_WHOLE, '{"int":null}': datum.NOT_WHOLE,
       '{"constructor":-1,"fields":[]}': datum.NOT_WHOLE, '{"bytes":"0"}': datum.NOT_HEX, '{"bytes":"FF"}': datum.NOT_HEX, '{"bytes":7}': datum.NOT_HEX, '{"list":{"int":1}}': datum.NOT_LIST, '{"map":[{"k":{"int":1}}]}': datum.NOT_PAIRS,
       '{"list":[{"int":1},{"what":2}]}': datum.UNKNOWN, '{"list":[{"list":[{"list":[{"list":[{"int":1}]}]}]}]}': datum.TOO_DEEP}


def test_data_round_trip_and_errors(spark):
    texts = [*GOOD, *BAD, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    out = {r.i: (r.datum, r.error) for r in datum.written(datum.nodes(rows, ["i"], "d", 4), ["i"]).collect()}
    assert len(out) == len(texts) - 1
    for i, text in enumerate(texts[:-1]):
        if text in BAD:
            assert out[i] == (None, BAD[text]), text
        else:
            assert out[i][1] is None and json.loads(out[i][0]) == json.loads(text) and " " not in out[i][0], text


def test_deep_data(spark):
    deep = '{"int":1}'
    for _ in range(7):
        deep = f'{{"constructor":1,"fields":[{deep}]}}'
    rows = spark.createDataFrame([(1, deep)], "i int, d string")
    assert datum.written(datum.nodes(rows, ["i"], "d"), ["i"]).first().datum == deep
