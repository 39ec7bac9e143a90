from __future__ import annotations

import hashlib
import re

import pytest

from tidemark.llm import decontamination as D


def words(text):
    return re.findall(D.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items, k=10):
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, x in items:
            x = words(x)
            n = min(k, len(x))
            grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(item)
        names = ",".join(sorted(str(x) for x in found if x is not None))
        yield doc, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest()


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = sorted(tuple(r)[:5] for r in D.op6_decontamination(spark, sf_dir).collect())
    assert out == sorted(brute(rows, items))


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (10, "A b c"), (2, "a b"), (3, ""), (4, None), (None, "null item"), (5, "x x x x x x x x x x x x"), (5, "x x x x x x x x x x x x"), (7, "b c d e f g h i j k l")]
ROWS = [(1, "zero ONE-two three four five six seven eight nine ten, eleven twelve"), (2, None), (3, ""), (4, "a, b. c"), (5, "x " * 25), (6, "null item"), (None, "a b"), (8, "c d e f g h i j k"), (8, "a b c d e f g h i j k l m"), (9, "one two three four five six seven eight nine")]


@pytest.mark.parametrize("block_words", [200_000, 10])
def test_edges(spark, block_words):
    docs = spark.createDataFrame([(*r, 0, "") for r in ROWS], "doc_id long, text string, n_words int, hits string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.find_hits(docs, items, block_words=block_words)
    out = [(r.doc_id, r.n_words, sum(s.end - s.start for s in D_merge(r.hits)), len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()) for r in found.collect()]
    assert sorted(out, key=str) == sorted(brute(ROWS, ITEMS), key=str)


def D_merge(hits):
    assert all(a.end < b.start for a, b in zip(hits, hits[1:]))
    return hits


def test_cleaned(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = D.find_hits(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    out = {(r.doc_id, r.text): r.cleaned for r in D.remove_hits(found).collect()}
    assert out[1, ROWS[0][1]] == "zero  twelve"
    assert out[2, None] is None and out[9, ROWS[9][1]] == ROWS[9][1]


ONE_WORD = [(1, "the"), (2, "a b"), (3, "one two three four five six seven eight nine ten eleven"), (4, "end")]
NEIGHBOURS = [(1, "of the"), (2, "the start, a"), (3, None), (4, "b end"), (5, "end"), (6, "one two three four five the"), (7, "six seven eight nine ten eleven the"), (8, ""), (9, "the end of the"), (10, "none")]


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_one_word_items_stay_inside_a_document(spark, block_words):
    docs = spark.createDataFrame(NEIGHBOURS, "doc_id long, text string").coalesce(1)
    found = D.find_hits(docs, spark.createDataFrame(ONE_WORD, "item_id long, text string"), block_words=block_words)
    rows = D.remove_hits(found).collect()
    out = [(r.doc_id, r.n_words, sum(s.end - s.start for s in D_merge(r.hits)), len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()) for r in rows]
    assert sorted(out) == sorted(brute(NEIGHBOURS, ONE_WORD))
    assert {r.doc_id: r.cleaned for r in rows} == {1: "of ", 2: " start, a", 3: None, 4: "b ", 5: "", 6: "one two three four five ", 7: "six seven eight nine ten eleven ", 8: "", 9: " of ", 10: "none"}


def test_very_long_text(spark, monkeypatch):
    """A text of 400,000 words with a window at its end, and more blocks of items than one stage searches."""
    monkeypatch.setattr(D, "BLOCKS", 2)
    items = [(i, " ".join(f"item{i}word{j}" for j in range(12))) for i in range(9)]
    rows = [(1, "filler " * 400_000 + items[4][1]), (2, " ".join(x for _, x in items)), (2, "clean")]
    found = D.find_hits(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, hits string"), spark.createDataFrame(items, "item_id long, text string"), block_words=40)
    out = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in D_merge(r.hits)), sorted(r["items"])) for r in found.collect())
    assert out == [(1, 400_012, 12, [4]), (2, 1, 0, []), (2, 108, 108, list(range(9)))]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find_hits(docs, items).collect() == []
    assert [r.n_words for r in D.find_hits(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).collect()] == [2]
