from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.simhash import fingerprints, hamming_links, op11_simhash_dedup, simhash_dedup


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(points, radius):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    every = np.array(points, dtype=np.uint64)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(every[:i] ^ every[i]) <= radius):
            parent[find(i)] = find(int(j))
    return [find(i) for i in range(len(points))]


def brute(rows, radius=4):
    prints = [fingerprint(t) for _, t in rows]
    found, least = components(prints, radius), defaultdict(list)
    for (doc, _), c in zip(rows, found):
        if doc is not None:
            least[c].append(doc)
    return sorted(((doc, f"{p:016x}", min(least[c], default=None)) for (doc, _), p, c in zip(rows, prints, found)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(op11_simhash_dedup(spark, sf_dir)) == expected
    assert len({x[2] for x in expected}) < len(expected)
    assert got(simhash_dedup(docs, shard=16)) == expected


def test_edges(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (6, "a b c d"), (7, "a  b\nc\td"), (7, "a b c d"), (8, words), (9, words + " x"), (None, words), (None, "only one here"), (10, "é ü ñ 中 文"), (11, "x" * 100_000), (12, "to be " * 60_000), (12, "to be " * 60_000)]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, print int, shard string")
    assert got(simhash_dedup(frame)) == brute(rows)


def test_empty(spark):
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_hash_is_that_of_spark(spark):
    assert fingerprints(pa.array(["one two three four"])).view(np.int64)[0] == spark.sql("select xxhash64('one two three four')").first()[0]


@pytest.mark.parametrize("radius", [0, 2, 4, 9])
@pytest.mark.parametrize("kind", ["spread", "dense", "chains"])
def test_links_as_brute_force(spark, radius, kind):
    rng = random.Random(f"{radius}{kind}")
    seeds = [rng.getrandbits(64) for _ in range({"spread": 900, "dense": 4, "chains": 12}[kind])]
    points = set(seeds)
    for s in seeds:
        for _ in range({"spread": 1, "dense": 400, "chains": 80}[kind]):
            for k in rng.sample(range(64), 3):
                s = s ^ (1 << k) if kind == "chains" else seeds[rng.randrange(len(seeds))] ^ (1 << k) ^ (1 << rng.randrange(64))
                points.add(s)
    points = sorted(points)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "print long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in hamming_links(frame, radius, shard=150, sample=400).collect()]
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    expected = components(points, radius)
    assert len({(find(p), c) for p, c in zip(points, expected)}) == len(set(expected)) == len({find(p) for p in points})


def test_the_bounds_prune():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000, dtype=np.uint64)
    compared = []
    near = simhash._near
    simhash._near = lambda own, others, hit: compared.append(hit.size) or near(own, others, hit)
    try:
        for _ in simhash.links(points, points[:0], 4):
            pass
    finally:
        simhash._near = near
    assert sum(compared) < 0.4 * len(points) ** 2
