from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, rows_of_frame, rows_of_sql
from tidemark.llm import hard_negatives as hn
from tidemark.llm.hard_negatives import SQL, hard_negatives, op12_hard_negatives


def brute(rows, positives=5, negatives=10):
    rows = [(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = sorted(set(rows), key=str)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, la, va in rows:
        if a is None or a % 100:
            continue
        other = [(dot(va, v), i, lab) for i, lab, v in rows if i != a]
        for sp, p, _ in sorted((x for x in other if x[2] == la), key=order)[:positives]:
            found = sorted((x for x in other if x[2] != la and 30 * sp <= 100 * x[0] <= 90 * sp), key=order)[:negatives]
            out += [(a, p, r + 1, n, sp, sn) for r, (sn, n, _) in enumerate(found)]
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id long, embedding array<float>, label int, want string, distance int")
    return got(hard_negatives(frame, F.col("vec_id") % 100 == 0, F.col("label"), **options))


def vectors(n, width, labels, seed, centres=8):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    rows = []
    for i in range(n):
        c = rng.choice(middle)
        rows.append((i, [x + rng.gauss(0, 0.4) for x in c], rng.randrange(labels)))
    return rows


def test_as_sql(spark, sf_dir):
    assert rows_of_frame(op12_hard_negatives(spark, sf_dir)) == rows_of_sql(connect(sf_dir), SQL)


@pytest.mark.parametrize("options", [{}, {"shard": 60, "pivots": 5, "sample": 200}, {"shard": 200, "batch": 2, "pivots": 1}])
def test_as_brute_force(spark, options):
    rows = vectors(1200, 6, 4, 11)
    assert mined(spark, rows, **options) == brute(rows)


def test_rare_labels_are_searched_to_the_end(spark):
    rows = [(i, v, 0 if i % 300 == 0 else 1) for i, v, _ in vectors(900, 5, 1, 5)]
    assert mined(spark, rows, shard=50, pivots=12) == brute(rows)


def test_edges(spark):
    rng = random.Random(2)
    rows = vectors(300, 4, 3, 1)
    rows += [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0], 1), (1002, [float("nan"), 0.0, 0.0, 0.0], 1), (1003, [float("inf"), 0.0, 0.0, 0.0], 1), (1100, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5], 1), (None, [0.4, 0.4, 0.4, 0.4], 2)]
    rows += [(2000 + i, [1.0, 1.0, 0.5, 0.25], i % 3) for i in range(120)]  # ties: one vector, three labels
    rows += [rows[100]] * 30 + [rows[7]] * 3  # repeated rows
    rows += [(3000, [0.0, 0.0, 0.0, 0.0], 1), (3001, [], 1), (3100, [], 2), (3002, [2.0, 2.0], 2)]
    rows += [(100, [rng.random() for _ in range(4)], 2)]  # an id with two vectors
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, shard=20, pivots=7) == brute(rows)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_too_large_is_refused(spark):
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e30], 1), (101, [1.0], 1)])


def test_bounds_spare_most_shards(spark, monkeypatch):
    """Between vectors of one length in few dimensions a search reads a small part of the index."""
    rows = [(i, [x / math.hypot(*v) for x in v], lab) for i, v, lab in vectors(4000, 3, 4, 9, centres=40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    some = hn.prepared(frame, F.col("label")).persist()
    index = hn.Index(some, 11, pivots=40, shard=100)
    shards = len(set(index.keys.shard.tolist()))
    queries = some.where("vec_id % 100 = 0").select(F.xxhash64("vec_id").alias("key"), "vec_id", "label", F.col("v").cast("array<int>").alias("v")).withColumn("wants", F.from_json(F.lit('[{"want":0}]'), hn.WANTS))
    counted = defaultdict(int)
    real = hn.written

    def watch(frame, name):
        out = real(frame, name)
        if name == "sent":
            counted["sent"] += out.count()
        return out

    monkeypatch.setattr(hn, "written", watch)
    assert index.search(queries, 5, True).count() == 40
    assert shards > 30 and counted["sent"] < 0.5 * 40 * shards
