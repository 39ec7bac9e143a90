from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from tidemark.llm.chunks import Deal, dealt
from tidemark.llm.substring_dedup import op7_substring_dedup, sha256, substring_dedup


def brute(rows, window):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    for k, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        yield k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("h")).collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = sorted((tuple(r) for r in op7_substring_dedup(spark, sf_dir).collect()), key=str)
    assert out == sorted(brute(rows, 35), key=str)
    assert got(substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), how=Deal(37, 11, 8))) == out


@pytest.mark.parametrize("window", [1, 2, 3])
def test_edges(spark, window):
    rows = [(1, "a b c a b c"), (2, None), (3, ""), (4, " \t\n"), (5, "a  b\nc d"), (5, "a  b\nc d"), (None, "x y"), (6, "é b z"), (7, "w" * 5000 + " q"), (8, "w" * 5000 + " q")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, chunk string, n_words int")
    assert got(substring_dedup(frame, window)) == sorted(brute(rows, window), key=str)


def test_many_rows_without_an_id(spark):
    """They are dealt over the chunks by their texts."""
    rows = [(None, f"w{i} " + "shared words of all " * (i % 3)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    how = Deal(16, 4, 4)
    assert dealt(frame, how, "doc_id", "text").select("chunk").distinct().count() == 16
    assert got(substring_dedup(frame, 3, how)) == sorted(brute(rows, 3), key=str)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string"), 3).collect() == []
