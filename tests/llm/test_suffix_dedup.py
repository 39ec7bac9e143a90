from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import suffix_dedup as S
from tidemark.llm.chunks import Deal


def brute(rows, size):
    texts = [(doc, (t or "").encode()) for doc, t in rows]
    seen = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    for doc, t in texts:
        gone = {j for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1 for j in range(i, i + size)}
        n_spans = sum(j - 1 not in gone for j in gone)
        yield doc, len(t), len(gone), n_spans, bytes(b for j, b in enumerate(t) if j not in gone)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in frame.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(S.suffix_dedup(docs)) == sorted(brute(rows, S.SIZE), key=str)
    assert got(S.suffix_dedup(docs, how=Deal(37, 11, 8))) == sorted(brute(rows, S.SIZE), key=str)
    assert S.op2_suffix_dedup(spark, sf_dir).count() == len(rows)


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_near_copies(spark, hot):
    """With the suffix arrays, and with every anchor too hot for one."""
    rng = random.Random(7)
    parts = ["".join(rng.choice("abcd é\n") for _ in range(rng.choice([30, 60, 150]))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3])))
        at = rng.randrange(len(text))
        rows.append((i // 2, text[:at] + rng.choice(["", "X", str(i)]) + text[at:]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.suffix_dedup(frame, 40, hot=hot)) == sorted(brute(rows, 40), key=str)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 30), (5, "xyz " * 11), (5, "xyz " * 11), (None, "tiny"), (6, "é" * 21), (7, "e" + "é" * 21), (8, "\0" * 45), (9, "\0" * 41)]
    frame = spark.createDataFrame([(*r, 1, "") for r in rows], "doc_id long, text string, chunk int, kept string")
    assert got(S.suffix_dedup(frame, 40)) == sorted(brute(rows, 40), key=str)
    assert S.suffix_dedup(frame.limit(0), 40).collect() == []


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_groups(spark, hot):
    """Every occurrence of every repeated window lies in a group; members are equal and no group has one only."""
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab é") for _ in range(70)) for _ in range(5)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3]))) + rng.choice(["", str(i)]) for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [t.encode() for t in texts]
    places = defaultdict(set)
    for d, t in enumerate(raw):
        for i in range(len(t) - 39):
            places[t[i : i + 40]].add((d, i))
    groups = defaultdict(list)
    for r in S.repeat_groups(frame, 40, hot=hot).collect():
        groups[r.repeat, r.length].append((r.doc_id, r.start))
    met = defaultdict(set)
    for (_, length), members in groups.items():
        assert len(members) == len(set(members)) > 1
        strings = {raw[d][i : i + length] for d, i in members}
        assert len(strings) == 1 and len(strings.pop()) == length
        for d, i in members:
            for j in range(length - 39):
                met[raw[d][i + j : i + j + 40]].add((d, i + j))
    assert met == {w: p for w, p in places.items() if len(p) > 1}


def test_nothing_goes_without_the_arrays(spark, monkeypatch):
    """Equal segments only carry verdicts: the tree's intervals are all that is removed."""
    table = S.pa.table({"kind": S.pa.array([1, 1, 3], S.pa.int32()), "bucket": S.pa.array([0] * 3, S.pa.int32()), "chunk": S.pa.array([0, 1, 2], S.pa.int32()), "anchor": [5, 5, 0], "body": [6, 6, 0], "again": [True, True, False], "data": [b"q" * 30 + b"xyz" * 9, b"q" * 30 + b"xyz" * 9, S.np.array([(5, 6)], dtype=S._PAIR).tobytes()]})
    assert [r["data"] for r in S._scan(table, 40).to_pylist() if r["kind"] == 3] == [b"\1"]
    other = table.set_column(6, "data", S.pa.array([b"q" * 30 + b"xyz" * 9, b"r" * 30 + b"zyx" * 9, table.column("data")[2].as_py()]))
    assert [r["data"] for r in S._scan(other, 40).to_pylist() if r["kind"] == 3] == [b"\0"]
    monkeypatch.setattr(S.SuffixArray, "repeats", lambda self, least: iter(()))
    assert [r["data"] for r in S._scan(table, 40).to_pylist() if r["kind"] == 3] == [b"\0"]


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
    strings += [rng.choice(strings), rng.choice(strings) + rng.choice(strings)]
    joined = b"".join(strings)
    starts = [sum(map(len, strings[:k])) for k in range(len(strings))]
    found = defaultdict(set)
    for k, s in enumerate(strings):
        for i in range(len(s)):
            for j in range(i + 2, len(s) + 1):
                found[s[i:j]].add((k, i))
    expected = set()
    for text, where in found.items():
        if len(where) < 2:
            continue
        left = {strings[k][i - 1] if i else (k, i) for k, i in where}
        right = {strings[k][i + len(text)] if i + len(text) < len(strings[k]) else (k, i) for k, i in where}
        if len(left) > 1 and len(right) > 1:
            expected.add((text, frozenset(starts[k] + i for k, i in where)))
    out = {(joined[p[0] : p[0] + n], frozenset(p.tolist())) for n, p in S.SuffixArray(strings).repeats(2)}
    assert out == expected
    for least in (5, 9, 20):  # arrays that sort no more than the wanted suffixes
        some = {(joined[p[0] : p[0] + n], frozenset(p.tolist())) for n, p in S.SuffixArray(strings, least).repeats(least)}
        assert some == {(s, p) for s, p in expected if len(s) >= least}
