from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np

from tidemark.llm import line_dedup as L
from tidemark.llm.chunks import Deal
from tidemark.llm.cuckoo import CuckooFilter


def brute(rows, min_chars=20, min_docs=3):
    def key(x):
        k = x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= min_chars else None

    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            held[k].append(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        yield doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def got(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in frame.collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in L.op9_line_dedup(spark, sf_dir).collect()), key=str) == sorted(brute(rows), key=str)


def test_edges(spark):
    a, b = "This line is long enough.", "Ünïcödé lines count code points"
    rows = [(1, f"{a}\nx\n {a.upper()}\t"), (2, a), (3, f"{a}\r\n{b}"), (4, None), (5, ""), (5, b), (5, b), (None, f"{b}\n{a}"), (6, "short\n" * 4), (7, "short"), (8, "short"), (9, "é" * 19), (10, "é" * 19), (11, "é" * 19)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, hi int")
    assert got(L.line_dedup(frame, shards=3)) == sorted(brute(rows), key=str)
    assert got(L.line_dedup(frame, shards=3, filter_bytes=0)) == sorted(brute(rows), key=str)


def test_very_long_texts(spark):
    """A line and a document beyond any of the table's, and a line that nearly all documents hold."""
    long = "word " * 400_000
    rows = [(i, f"{long if i < 4 else ''}\nshared by all of the documents\nown line of document number {i}") for i in range(40)]
    rows += [(100, "\n".join(f"line number {i} of a long text" for i in range(100_000))), (101, "\n" * 100_000)]
    assert got(L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shards=5)) == sorted(brute(rows), key=str)


def test_hot_ids(spark):
    """A third of all rows without an id, another third with one: both are spread over the chunks."""
    own = lambda i: "\n".join([f"line number {i % 40} of the boilerplate", f"another line, number {i % 7}", f"own line of document number {i}"])
    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else None, own(i)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    how = Deal(16, 4, 8)
    assert got(L.line_dedup(frame, how=how)) == sorted(brute(rows), key=str)
    assert got(L.line_dedup(frame, how=how, filter_bytes=0)) == sorted(brute(rows), key=str)
    passed = L.lookup(L.line_refs(frame, how=how), L.active(L.totals(L.line_refs(frame)), 4))
    times = dict(passed.where("doc_id is null").groupBy("chunk").count().collect())
    assert len(times) == 16 and max(times.values()) < 0.15 * sum(times.values())


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_insert_and_delete(spark):
    """Documents that come and go leave the index as if it had been built from what is there."""
    rng = random.Random(3)
    lines = [f"line number {i} of the boilerplate" for i in range(12)]
    make = lambda ids: [(i, "\n".join(rng.sample(lines, 4))) for i in ids]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    old, new = make(range(10)), make(range(10, 16))
    gone, left = old[3:8], old[:3] + old[8:] + new
    refs = L.line_refs(frame(old))
    exact = L.totals(refs)
    before = L.active(exact, 2)
    states = L.build(before)
    come, went = L.line_refs(frame(new)), L.line_refs(frame(gone))
    refs = L.merge_refs(refs, come, went)
    exact = L.changed_totals(exact, refs, come.unionByName(went))
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, L.totals(refs).collect()))
    after = L.active(exact, 2)
    states = L.update(states, after)
    assert got(L.drop_lines(frame(left), L.lookup(L.probed(refs, states, 2), after))) == sorted(brute(left), key=str)
    filters = L.broadcast_filters(states, 2)
    assert got(L.drop_lines(frame(left), L.lookup(L.line_refs(frame(left), filters=filters), after))) == sorted(brute(left), key=str)
    was, now = dict((r[0], r) for r in brute(old)), dict((r[0], r) for r in brute(left))
    changed = {i for i in was.keys() & now.keys() if was[i] != now[i]}
    assert changed and changed <= {r.doc_id for r in L.affected(refs, before, after).collect()}
    for row in states.collect():
        filter_ = CuckooFilter.load(row["filter"])
        hi, lo = (np.frombuffer(row[c], dtype=np.int64) for c in ("hi", "lo"))
        assert filter_.contains(hi, lo).all()
        assert int((filter_.table > 0).sum()) == len(hi)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 4000), dtype=np.int64)
    f = CuckooFilter.built(hi[:2000], lo[:2000])
    assert f.contains(hi[:2000], lo[:2000]).all()
    assert f.contains(hi[2000:], lo[2000:]).mean() < 0.01
    f.delete(hi[:1000], lo[:1000])
    assert f.contains(hi[1000:2000], lo[1000:2000]).all()
    assert f.contains(hi[:1000], lo[:1000]).mean() < 0.01
    f.insert(hi[2000:2500], lo[2000:2500])
    assert CuckooFilter.load(f.dump()).contains(hi[1000:2500], lo[1000:2500]).all()
