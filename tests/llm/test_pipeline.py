from __future__ import annotations

import importlib
import re
from collections import Counter

import numpy as np
import tiktoken
from pyspark.sql import types as T

import corpus_pipeline
from tests.llm.test_jaccard_join import brute as components
from tidemark.llm import bpe, decontamination, quality_rules


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    texts = {i: r.text for i, r in rows.items() if i in kept}

    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    held, last = Counter(), {}
    for i in sorted(texts):
        for k in {key(x) for x in texts[i].split("\n")}:
            held[k] += 1
            last[k] = i
    texts = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or held[key(x)] < 3 or last[key(x)] == i) for i, t in texts.items()}

    texts = {i: texts[i] for i, _, least in components(list(texts.items())) if i == least}

    items = [re.findall(decontamination.WORD, r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1)}
    with open(bpe.default_vocabulary()[0], "rb") as file:
        library = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=bpe.parse_ranks(file.read()), special_tokens={})

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert out.keys() == texts.keys()
    changed = 0
    for i, r in out.items():
        text = library.decode(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert r.round_trip and r.n_tokens == len(r.ids) // 4 and r.n_chars == len(text)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(text)
        assert (r.lang, r.source) == (rows[i].lang, rows[i].source)
        words = re.findall(decontamination.WORD, text.lower())
        assert not any(tuple(words[a : a + n]) in grams for n in {len(g) for g in grams} for a in range(len(words) - n + 1))
        hit = [m.span() for m in re.finditer(decontamination.WORD, texts[i].lower())]
        if text != texts[i]:
            changed += 1
            assert len(words) < len(hit)
    assert changed


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]
    odd = spark.createDataFrame([(None, None, None, "s", None, "x"), (1, "", "en", None, 0, "y"), (1, "a b " * 20, "en", "s", 3, "z")], T.StructType([*docs.schema.fields, T.StructField("row", T.StringType())]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, odd, sf_dir).columns == odd.columns
        stage(spark, odd, sf_dir).collect()
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    last = corpus_pipeline.tokens(spark, odd, sf_dir)
    assert sorted(r.n_tokens > 0 for r in last.collect()) == [False, False, True]


def test_entry_registers_the_pipeline():
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
