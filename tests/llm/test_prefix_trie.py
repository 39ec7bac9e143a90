from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tests.oracle import connect, rows_of_frame, rows_of_sql
from tidemark.llm import prefix_trie as pt
from tidemark.llm.prefix_trie import SQL, op13_prefix_trie, prefix_trie


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ended = defaultdict(set), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(int(c - math.fmod(c, 20)), [])[:h] + ts[h:]
        ended[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode().split()) if node else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids[node], leaves[node], saved[node], sha(ended.get(node, []))) for node, of in members.items()), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def built(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, key string, n int")
    return got(prefix_trie(frame, **options))


def test_as_sql(spark, sf_dir):
    assert rows_of_frame(op13_prefix_trie(spark, sf_dir)) == rows_of_sql(connect(sf_dir), SQL)


def test_whole_table_in_small_shards(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    assert got(op13_prefix_trie(spark, sf_dir)) == brute(rows) == got(prefix_trie(frame, shard=300))


@pytest.mark.parametrize("shard", [1, 200, 900, 5000])
def test_few_words_many_prefixes(spark, shard, monkeypatch):
    """Conversations that extend, repeat and branch off each other, over many shards."""
    monkeypatch.setattr(pt, "IDS", 3)
    rng = random.Random(shard)
    rows = []
    for c in range(400):
        n = rng.choice([1, 1, 2, 3, 4, 9])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t % 2 else "user", rng.choice(["a", "a", "a b", "c d e"])))
    rows += [(1000 + c, t, "user", f"long {t}") for c in range(40) for t in range(60 + c % 3)]
    assert built(spark, rows, shard=shard) == brute(rows)


def test_edges(spark):
    rows = [(1, None, "user", "x y"), (1, 0, None, None), (1, 0, "a", "b"), (1, 0, "a", "b"), (None, 0, "user", "lost"), (2, 0, "user", ""), (2, 1, "user", " \t\n")]
    rows += [(20, i, "user", f"t{i}") for i in range(5)] + [(c, 0, "user", "short") for c in range(21, 40)] + [(c, i, "u", "own") for c in range(61, 79) for i in range(3)]
    rows += [(-3, 0, "user", "below"), (-25, 0, "user", "below"), (-20, 0, "user", "below zero"), (0, 0, "1:", "ab"), (5, 0, "1", ":ab"), (80, 0, "user", "w " * 200_000), (81, 0, "é", "ü x")]
    assert built(spark, rows) == brute(rows)
    assert built(spark, rows, shard=1) == brute(rows)


def test_empty(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 0, "user", "x")]) == []


def test_only_turnless(spark):
    """Conversations whose own turns all give way to a head that does not exist."""
    some = [c for c in range(1, 4000) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:50]
    rows = [(c, 0, "user", "gone") for c in some]
    assert built(spark, rows) == brute(rows)
    assert len(brute(rows)) == 1
