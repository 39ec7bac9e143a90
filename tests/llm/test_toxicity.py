from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tidemark.llm import quality_rules as Q
from tidemark.llm import toxicity as T

LARGE = "/root/testdata/sf0.1"


def labelled(sf_dir):
    labels = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    return [r | labels[r["doc_id"]] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist() if r["doc_id"] in labels]


def test_toxic_documents_of_every_language_are_rejected(spark):
    """Fitted on one half of the labels, held against the other."""
    rows = labelled(LARGE)
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    found = T.frequent(docs, labels.where("doc_id % 2 = 0"))
    assert set(found) == {"de", "en", "es", "fr"}
    held = [r for r in rows if r["doc_id"] % 2]
    texts = Q.Texts(pa.array([r["text"] for r in held]))
    rules = (*Q.RULES, Q.frequent_stems(found))
    kept = ~Q.base_failed(texts) & (Q.cascade(texts, rules) < 0)
    toxic, clean = Counter(), defaultdict(list)
    for r, k, fine in zip(held, kept, ~Q.base_failed(texts)):
        if r["toxic"]:
            toxic[r["lang"], bool(k)] += 1
        elif r["quality"] and fine:
            clean[r["lang"]].append(bool(k))
    assert {lang for lang, _ in toxic} == {"de", "en", "es", "fr"} == set(clean)
    assert not any(k for _, k in toxic)
    assert all(sum(k) > 0.98 * len(k) for k in clean.values())


def test_the_pipeline_and_the_query_drop_them(spark):
    """By one rule; a table with fewer labels than the fit needs has none."""
    out = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{LARGE}/documents.parquet"), LARGE).select("doc_id").collect()}
    toxic = [r for r in labelled(LARGE) if r["toxic"]]
    assert {r["lang"] for r in toxic} == {"de", "en", "es", "fr"} and not out & {r["doc_id"] for r in toxic}
    assert out == {r.doc_id for r in Q.op4_quality_rules(spark, LARGE).where("kept").select("doc_id").collect()}


def test_words_that_only_this_table_marks(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau ypsilon"
    rows = [(i, "xx", f"{body} {i} grumpf{'abcde'[i % 5]} end" if i % 3 == 0 else f"{body} {i} end") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rules = Q.rules_for(docs, labels)
    assert sorted(r.doc_id for r in Q.keep(docs, rules).collect()) == [i for i in range(90) if i % 3]
    assert T.frequent(docs, labels.limit(0)) == {}


def test_long_texts_count_to_their_ends(spark):
    """What marks a text may stand behind any number of other words."""
    body = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(12_000))
    rows = [(i, "xx", f"{body} end{i} " + ("grumpf " * 200 if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    rule = Q.frequent_stems(T.frequent(docs, labels))
    assert rule.rejects(Q.Texts(pa.array([r[2] for r in rows]))).tolist() == [bool(i % 2) for i in range(40)]
