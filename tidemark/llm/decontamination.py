"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. The automaton is built over all items; the words
of a document stream through it and the longest matching length is tracked at each word. A match counts once its
length reaches the item's limit: `min_words` words, or `min_coverage` of an item with fewer words. All words inside
such a match are hit.

Before the automaton, a vectorised test drops runs of words in which no short gram belongs to an item: no match that
counts can lie there. Items are taken to the driver in blocks of about `block_words` words (the bound of each
broadcast). Up to BLOCKS of them pass over the documents in one stage; then what was found is written, their broadcasts
are given up and the next BLOCKS follow, so a worker never holds more than BLOCKS * block_words words of items.

Defined results: null and empty texts have no words; items without words are ignored; an item without an id can hit
but is not listed; repeated items or ids are listed once; an empty table on either side gives no hits; repeated rows and ids
of documents are judged row by row; other columns, whatever their names, are handed on in `row`. Of a document that is
cleaned, the words on both sides of a cut become neighbours and are not matched again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chunks, textbytes
from tidemark.llm.shared import others, restored, written
from tidemark.llm.substring_dedup import sha256

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_FOUND = "doc_id long, text string, n_words long, hits array<struct<start:long,end:long>>, items array<long>"
#: The words of items that one broadcast holds, about.
BLOCK_WORDS = 200_000
#: The blocks that are searched in one stage.
BLOCKS = 8


class Automaton:
    """Generalised suffix automaton over word ids; state 0 is the root."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], min_words: int, min_coverage: float):
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.targets: dict[tuple[int, int], list[int]] = {}
        coded = [(key, [self.ids.setdefault(w, len(self.ids)) for w in words]) for key, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for key, words in coded:
            limit = min(min_words, max(1, math.ceil(min_coverage * len(words))))
            state, length = 0, 0
            for w in words:
                state, length = self.step[state][w], length + 1
                if length >= limit:
                    keys = self.targets.setdefault((self.shrink(state, limit), limit), [])
                    if key is not None and key not in keys:
                        keys.append(key)
        self.limits = sorted({n for _, n in self.targets})

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, w, q)
        new, p = len(self.step), last
        self.step.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def shrink(self, state: int, length: int) -> int:
        """The state of the last `length` words that led to `state`."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(end, length, item ids) of the matches that count, word by word."""
        state, length = 0, 0
        for i, word in enumerate(words):
            w = self.ids.get(word, -1)
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.step[state]:
                state, length = self.step[state][w], length + 1
            for limit in self.limits:
                if limit > length:
                    break
                found = self.targets.get((self.shrink(state, limit), limit))
                if found is not None:
                    yield i + 1, limit, found


def _grams(data: np.ndarray, offsets: np.ndarray, size: int):
    low = textbytes.LOWER[data]
    starts, ends, first = textbytes.spans(low, offsets, textbytes.ALNUM)
    hashes = textbytes.rolling(textbytes.word_hashes(low, starts, ends), size)
    hashes[~textbytes.inside_text(first, size)] = 0
    return low, starts, ends, first, hashes


def _block(items: list[tuple[int | None, str]], min_words: int, min_coverage: float) -> tuple[Automaton, int, np.ndarray]:
    """The automaton, the gram size of the test before it, and the items' grams."""
    data, offsets = textbytes.flatten(pa.array([t for _, t in items], pa.string()))
    low = textbytes.LOWER[data]
    starts, ends, first = textbytes.spans(low, offsets, textbytes.ALNUM)
    raw = low.tobytes()
    words = [[raw[starts[i] : ends[i]] for i in range(a, b)] for a, b in zip(first[:-1], first[1:])]
    automaton = Automaton([(k, w) for (k, _), w in zip(items, words)], min_words, min_coverage)
    size = min([3, *automaton.limits])
    return automaton, size, np.unique(_grams(data, offsets, size)[4])


def find_hits(docs: DataFrame, items: DataFrame, min_words: int = 10, min_coverage: float = 1.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, the hit word intervals and the item ids of each document; other columns in `row`."""
    spark = docs.sparkSession
    sized = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / (4 * block_words)))
    out = docs.select("doc_id", "text", others(docs), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("hits"), F.expr("cast(array() as array<long>)").alias("items"))
    schema = T.StructType.fromDDL(_FOUND).add("row", out.schema["row"].dataType)
    shared: list = []
    for b in range(blocks):
        if len(shared) == BLOCKS:
            out = written(out, "hits")
            while shared:
                shared.pop().unpersist()
        part = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in part.collect()]
        shared.append(spark.sparkContext.broadcast(_block(rows, min_words, min_coverage)))
        out = out.mapInArrow(_search(shared[-1]), schema)
    return out


def _search(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size, known = shared.value
        least = min(automaton.limits, default=1)
        for batch in batches:
            for table in chunks.slices(pa.Table.from_batches([batch])):
                yield from _match(table, automaton, size, known, least).to_batches()

    return search


def _match(table: pa.Table, automaton: Automaton, size: int, known: np.ndarray, least: int) -> pa.Table:
    data, offsets = textbytes.flatten(table.column("text"))
    low, starts, ends, first, grams = _grams(data, offsets, size)
    member = (known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams) & (grams != 0) if len(known) else np.zeros(len(grams), bool)
    lo, hi = textbytes.runs(member)
    # a run ends with its document: grams of one word leave no gap between documents
    borders = np.unique(first[1:-1])
    inner = borders[(borders > 0) & (borders < len(member))]
    inner = inner[member[inner - 1] & member[inner]]
    lo, hi = np.union1d(lo, inner), np.union1d(hi, inner)
    wide = hi - lo >= least - size + 1
    hits = table.column("hits").to_pylist()
    keys = table.column("items").to_pylist()
    for a, b, doc in zip(lo[wide], hi[wide] + size - 1, np.searchsorted(first, lo[wide], side="right") - 1):
        words = [low[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b])]
        at = int(a - first[doc])
        for end, length, found in automaton.stream(words):
            hits[doc].append({"start": at + end - length, "end": at + end})
            keys[doc].extend(found)
    counts = pa.array(np.diff(first), pa.int64())
    columns = {"doc_id": table.column("doc_id"), "text": table.column("text"), "n_words": counts, "hits": pa.array([_merge(h) for h in hits], _HITS), "items": pa.array([sorted(set(k)) for k in keys], pa.list_(pa.int64())), "row": table.column("row")}
    return pa.table(columns)


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def hit_words(hits: str | Column = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def remove_hits(found: DataFrame) -> DataFrame:
    """The documents with a column `cleaned`: the text without its hit spans (from a span's first to its last word)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = table.schema.get_field_index("text")
            out = table.column("text").to_pylist()
            for i, hits in enumerate(table.column("hits").to_pylist()):
                if hits:
                    out[i] = _without(out[i].encode(), hits)
            yield from table.add_column(at + 1, "cleaned", pa.array(out, pa.string())).to_batches()

    schema = T.StructType()
    for field in found.schema:
        schema = schema.add(field).add("cleaned", "string") if field.name == "text" else schema.add(field)
    return found.mapInArrow(cut, schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, with all their columns, without the spans that match an item."""
    return restored(remove_hits(find_hits(docs, items)), docs, "cleaned")


def _without(raw: bytes, hits: list[dict]) -> str:
    data, offsets = textbytes.flatten(pa.array([raw], pa.binary()))
    starts, ends, _ = textbytes.spans(textbytes.LOWER[data], offsets, textbytes.ALNUM)
    keep, last = [], 0
    for s in hits:
        keep.append(raw[last : starts[s["start"]]])
        last = ends[s["end"] - 1]
    return b"".join([*keep, raw[last:]]).decode()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha256(F.array_join(names, ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(found.n_items, 0) AS n_items,
       sha256(coalesce(found.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
