from __future__ import annotations

import random
from itertools import accumulate

from tidemark.streaming import ranges


def test_batches_of_ranges_in_any_order(spark):
    slots = [*range(500), *range(10**6, 10**6 + 500), 10**9]
    rows = [(s, i // 90 if i < 700 else 7, i % 13 - 4) for i, s in enumerate(slots)]
    mixed = random.Random(5).sample(rows, len(rows))
    frame = spark.createDataFrame(mixed, "slot_no long, epoch_no long, value long")
    folder = ranges.recorded(spark, frame, size=100)
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("range").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 300
    left, summaries = ranges.run(spark, folder, files=2)
    assert left.select("batch_id").distinct().count() > 4 and summaries.count() == len(sizes)
    first = [(s, e) for i, (s, e, _) in enumerate(rows) if not i or rows[i - 1][1] != e]
    assert sorted(tuple(r) for r in ranges.first_of_epoch(left, summaries).collect()) == first
    totals = list(zip(slots, accumulate(v for _, _, v in rows)))
    assert sorted(tuple(r) for r in ranges.running_fold(left, summaries).collect()) == totals
