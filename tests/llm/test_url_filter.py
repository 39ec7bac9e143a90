from __future__ import annotations

import random
import re
import time
from datetime import date, timedelta

from tidemark.llm import url_filter as U


def brute(captures, entries):
    for i, url, at in captures:
        m = re.match(U.HOST, url or "")
        out = set()
        if m and at:
            name = m[1].lower()
            path = re.match(U.PATH, url)
            parts = [p for p in path[1].split("/") if p] if path else []
            labels = name.split(".")
            keys = [("domain", ".".join(labels[k:])) for k in range(len(labels))] + [("prefix", f"{name}/{'/'.join(parts[:k])}") for k in range(1, len(parts) + 1)]
            for key in keys:
                since = None
                for d in sorted({e[3] for e in entries if e[:2] == key and None not in e and e[3] <= at and e[2] in ("add", "remove")}):
                    removes = any(e[:2] == key and e[2] == "remove" and e[3] == d for e in entries)
                    since = None if removes else since or d
                if since:
                    out.add((*key, since))
        yield i, url, at, sorted(out)


def got(frame):
    return sorted(((r.id, r.url, r.fetched_at, [tuple(m) for m in r.matches]) for r in frame.collect()), key=str)


def frames(spark, captures, entries):
    left = spark.createDataFrame([(*c, 1, "x") for c in captures], "id long, url string, fetched_at date, salt int, kind string")
    return left, spark.createDataFrame(entries, "kind string, pattern string, action string, at date")


def test_random(spark):
    rng = random.Random(4)
    day = lambda: date(2024, 1, 1) + timedelta(rng.randrange(12))
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org"]
    entries = [(*rng.choice([("domain", "example.com"), ("domain", "a.example.com"), ("domain", "org"), ("prefix", "other.org/x"), ("prefix", "other.org/x/y")]), rng.choice(["add", "add", "remove"]), day()) for _ in range(40)]
    captures = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['', 'x', 'x/y/z', 'xy', '/x//y'])}", day()) for i in range(200)]
    out = got(U.active_entries(*frames(spark, captures, entries)))
    assert out == sorted(brute(captures, entries), key=str)
    assert any(m for *_, m in out)


def test_edges(spark):
    d = date(2024, 5, 1)
    entries = [("domain", "a.com", "add", d), ("domain", "a.com", "add", d), ("domain", None, "add", d), ("domain", "b.com", "add", None), ("domain", "c.com", "drop", d), (None, "a.com", "add", d)]
    captures = [(1, None, d), (2, "", d), (3, "no url", d), (4, "http://A.com:80/x?q#f", d), (4, "http://A.com:80/x?q#f", d), (4, "http://b.com", d), (None, "http://u:p@x.a.com", d), (5, "http://a.com", None), (6, "http://a.com/" + "y/" * 500, d), (7, "http://c.com", d)]
    left, right = frames(spark, captures, entries)
    assert got(U.active_entries(left, right)) == sorted(brute(captures, entries), key=str)
    assert all(not m for *_, m in got(U.active_entries(left, right.limit(0))))
    assert U.active_entries(left.limit(0), right).collect() == []


def test_long_urls(spark):
    """100,000 segments or labels cost what the list's few sizes ask for; a bracketed address is a host."""
    d = date(2024, 5, 1)
    entries = [("prefix", "a.com/y/y/y", "add", d), ("domain", "b.c", "add", d), ("domain", "[::1]", "add", d), ("prefix", "a.com", "add", d)]
    captures = [(1, "http://a.com/" + "y/" * 100_000, d), (2, "http://" + "b." * 100_000 + "c/x", d), (3, "http://[::1]:80/x", d), (4, "http://[::1", d), (5, "http://a.com", d)]
    began = time.monotonic()
    out = {i: m for i, _, _, m in got(U.active_entries(*frames(spark, captures, entries)))}
    assert time.monotonic() - began < 60
    assert out == {1: [("prefix", "a.com/y/y/y", d)], 2: [("domain", "b.c", d)], 3: [("domain", "[::1]", d)], 4: [], 5: []}


def test_query(spark, sf_dir):
    rows = U.op10_url_filter(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.kept == (r.n_entries == 0) for r in rows)
    entries = U.feed(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert {e.kind for e in entries} == {"domain", "prefix"} and {e.action for e in entries} == {"add", "remove"}
