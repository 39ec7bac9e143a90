"""Substring dedup by Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Tokens are the words [^\\x20\\x09-\\x0D]+, unchanged. Every window of `window` tokens of one document is hashed; the
hashes are counted per hash bucket; each word inside a window whose hash occurs elsewhere is removed, so repeated
windows merge into maximal removal intervals. Windows are judged on the input, not on what is left.

Defined results: null and empty texts have no words; a text with fewer words than a window keeps all; rows that
repeat a doc_id (or have none) count as documents of their own, so an exactly repeated row loses its windows in
both; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, textbytes

SCHEMA = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string"


def _windows(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows, the word at which each begins, and the first word of each document."""
    data, offsets = textbytes.flatten(table.column("text"))
    starts, ends, first = textbytes.spans(data, offsets, textbytes.NOT_SPACE)
    hashes = textbytes.rolling(textbytes.word_hashes(data, starts, ends), window)
    ok = textbytes.inside_text(first, window)
    return hashes[ok], np.flatnonzero(ok), first


def substring_dedup(docs: DataFrame, window: int = 35, how: chunks.Deal | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, the maximal removed intervals (in words) and the kept words joined by a space."""
    how = how or chunks.deal(docs)
    placed = chunks.dealt(docs, how, "doc_id", "text")
    buckets = how.buckets

    def send(key: tuple, table: pa.Table) -> pa.Table:
        return chunks.blobs(np.unique(_windows(table, window)[0]), key[0].as_py(), buckets)

    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, at, first = _windows(texts, window)
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = (times > 1) | (chunks.gather(answers) > 0)
        gone = textbytes.covered(int(first[-1]), at[twice[which]], window)
        rows = {k: [] for k in ("doc_id", "n_words", "n_removed", "intervals", "kept_text")}
        rows["doc_id"] = texts.column("doc_id")
        for text, a, b in zip(texts.column("text"), first[:-1], first[1:]):
            raw = text.as_buffer()
            words, flags = (b"" if raw is None else raw.to_pybytes()).split(), gone[a:b]
            lo, hi = textbytes.runs(flags)
            if len(lo):
                keep = np.flatnonzero(~flags).tolist()
                kept = [words[i] for i in keep]
            else:
                kept = words
            rows["n_words"].append(len(words))
            rows["n_removed"].append(len(words) - len(kept))
            rows["intervals"].append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
            rows["kept_text"].append(b" ".join(kept).decode())
        return pa.table(rows, schema=_ARROW)

    sent = placed.groupBy("chunk").applyInArrow(chunks.tidy(send), chunks.BLOBS)
    found = chunks.answer(sent, how, lambda n: np.minimum(n, 2))
    return placed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(chunks.tidy(remove), SCHEMA)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_text", pa.string()),
    ]
)


def sha256(text: str | Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM g SEMI JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
