from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tidemark.llm.chunks import Deal
from tidemark.llm.jaccard_join import jaccard_join, op5_jaccard_join, representatives


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if common and 100 * common >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return sorted(((doc, len(sets[i]), min(least[find(i)], default=None)) for i, (doc, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op5_jaccard_join(spark, sf_dir)) == brute(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(jaccard_join(docs, how=Deal(37, 11, 8))) == brute(rows)


@pytest.mark.parametrize("limit", [4_000_000, 40])
def test_near_copies(spark, limit):
    """Both the groups in one task and the blocks against all rows."""
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 5, 8, 20, 60]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10)}"
            rows.append((len(rows) * 3 % 101, " ".join(w)))
    assert got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), limit)) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (2, ""), (9, "A b"), (8, "a  B"), (7, "a b c"), (None, "a b c"), (None, "z"), (6, "q " * 4000), (1, "q " * 4001), (1, "a b")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, chunk string, n long")
    assert got(jaccard_join(frame)) == brute(rows)


def test_representatives(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(3, a, "x"), (2, a + " eleven", "y"), (5, a, "z"), (7, "quite another text than those", "w"), (None, a, "n"), (None, "of its own, with no id", "m"), (8, None, "e"), (9, "", "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, leads string")
    out = representatives(frame)
    assert out.columns == frame.columns
    assert sorted(r.leads for r in out.collect()) == ["e", "e", "m", "n", "w", "y"]


def test_empty(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
