from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import quality_rules as Q


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = Counter()
    for r in Q.op4_quality_rules(spark, sf_dir).collect():
        stats = brute(texts[r.doc_id])
        assert tuple(r)[1:6] == stats
        assert r.base_failed == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert not (r.base_failed and r.kept)
        if not r.base_failed and r.doc_id in labels:
            clean[labels[r.doc_id][0], r.kept] += labels[r.doc_id] != (1, 1)
    assert clean[1, False] == 0 and clean[0, True] == 0


TEXTS = [None, "", " \n\t", "one two", "a b c d e f g h i j k", "x " * 30, "é ü\nsame line\nsame line\n\n\n", "w" * 9000, "#*$%&|<> " * 12, "An idiot said one two three four five six seven eight nine"]


def test_edges(spark):
    frame = spark.createDataFrame([(i % 4 or None, t, 7, "") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, kept string")
    out = sorted(tuple(r)[1:6] for r in Q.judge(frame).collect())
    assert out == sorted(map(brute, TEXTS))
    assert Q.judge(frame.limit(0)).collect() == []


def test_order_changes_the_work_only():
    column = pa.array([t for t in TEXTS if t], pa.string())
    rules = list(Q.RULES)
    one, two = Q.cascade(Q.Texts(column), rules) < 0, Q.cascade(Q.Texts(column), rules[::-1]) < 0
    assert (one == two).all()


def test_order_follows_rejections_per_cost():
    """Among the texts that pass the base test and the rules before: a rule that rejects only what is gone comes late."""
    words = "one two three four five six seven eight nine ten {}"
    column = pa.array([words.format(i) for i in range(40)] + ["short"] * 200, pa.string())

    def rule(name, seconds, flags):
        def rejects(t):
            time.sleep(seconds)
            return np.array([flags(x.split()) for x in t.column.to_pylist()], dtype=bool)

        return Q.Rule(name, rejects)

    number = lambda w: int(w[-1]) if w[-1].isdigit() else -1
    rules = [
        rule("slow", 0.2, lambda w: number(w) >= 10),
        rule("only short", 0.0, lambda w: len(w) < 5),
        rule("fast", 0.02, lambda w: number(w) >= 20),
        rule("same as fast", 0.03, lambda w: number(w) >= 20),
    ]
    assert [r.name for r in Q.ordered(column, rules)] == ["fast", "slow", "only short", "same as fast"]
    assert [r.name for r in Q.ordered(column.slice(0, 0), rules)][0] == "only short"


def test_features_go_along():
    texts = Q.Texts(pa.array(TEXTS, pa.string()))
    rows = np.array([9, 3, 6])
    known = {c: getattr(texts, c) for c in Q.Texts.COUNTS}
    for c, own in known.items():
        assert (getattr(texts.take(rows), c) == own[rows]).all() and (getattr(Q.Texts(texts.column.take(pa.array(rows))), c) == own[rows]).all()


def test_repeated_lines_and_toxic_stems(spark):
    """Short lines between others are found; stems are learnt from the labels, in any language."""
    menu = "\n".join(f"Read more\nown{i} sentence{i} of{i} text{i}\nShare\nanother{i} one{i} with{i} number{i}" for i in range(6))
    clean = lambda i: " ".join(f"wort{i * 31 % 97 + j} satz{i % 53 + j} {chr(97 + (i + j) % 26) * 5}" for j in range(10))
    rows = [(i, "xx", clean(i) + (f" übelkeit{i} übelheit" if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, "xx", menu), (101, "xx", f"{clean(5)} übelkeiten"), (102, None, "übelkeitlich " * 3 + clean(70)), (103, "xx", None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, 1, 1), (103, 0, 0)], "doc_id long, quality int, toxic int")
    found = Q.toxicity.frequent(docs, labels)
    assert set(found) == {"xx"} and set(found["xx"].stems) == {"übel", "übelk", "übelke", "übelkei", "übelkeit", "übelh", "übelhe", "übelhei", "übelheit"}
    out = {r.doc_id: r.rejected_by for r in Q.judge(docs, (*Q.RULES[3:4], Q.frequent_stems(found))).collect()}
    assert out[100] == "repeated_lines" and out[101] == "frequent_stems" and out[102] == "frequent_stems"
    assert all(out[i] in ("base", "frequent_stems") if i % 2 else out[i] in (None, "base") for i in range(60))
    assert Q.toxicity.frequent(docs, labels.limit(0)) == {} == Q.toxicity.frequent(docs.limit(0), labels)
