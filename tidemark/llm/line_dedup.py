"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased, held as a 128-bit hash.
The exact table has one row per key with the number of documents that hold it and the largest doc_id; the references
behind it, one per document and key, can be added and taken away. A key is active once `min_docs` documents hold it.
Each shard has a cuckoo filter of its active keys. A lookup goes to the filters first - in the task that reads the
document while all filters fit FILTER_BYTES, else in the key's shard - and only what they let pass travels to the exact
table, keys that many documents hold in parts. When documents come or go, only their keys are counted again, keys that
cross the limit are inserted into the filter or deleted from it, and `affected` names the documents whose text changes;
decisions are as if the index had been built anew. Keys that drop meet the texts chunk by chunk (a hash of doc_id and
text), so many rows without an id, or with one, are spread, and a task gets no more keys than its chunk has lines.

Decision: an active key loses all its lines but those in the largest doc_id that holds it.

Defined results: null and empty texts are one empty line; keys under `min_chars` code points never drop; rows that
repeat a doc_id count as documents of their own and get the same decision; a row without a doc_id counts, and drops
its active lines if any holder has an id; an empty table gives an empty table; other columns are ignored. A very long
text or line is read whole, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chunks
from tidemark.llm.cuckoo import CuckooFilter, FilterSet, Full
from tidemark.llm.shared import hot_keys, others, restored, spread_join, written
from tidemark.llm.substring_dedup import sha256

MIN_CHARS, MIN_DOCS = 20, 3
REFS = "hi long, lo long, doc_id long, n long"
PLACED = f"{REFS}, chunk int"
STATE = "shard int, filter binary, hi binary, lo binary, last binary"
#: Filters of at most so many bytes are broadcast, about 25 million active keys; beyond that each shard probes its own.
FILTER_BYTES = 64 << 20
#: In that case the lookups of one shard are dealt to so many tasks.
SALTS = 64
_NO_ID = np.iinfo(np.int64).min


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    h = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _lines(text) -> list[bytes]:
    raw = text.as_buffer()
    return (b"" if raw is None else raw.to_pybytes()).split(b"\n")


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS, filters: Broadcast | None = None, how: chunks.Deal | None = None) -> DataFrame:
    """One reference (n = 1) for each row and distinct key in it; of keys that the filters let pass, if there are any. With
    `how` the row's chunk goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in chunks.slices(pa.Table.from_batches([batch])):
                hi, lo, owner = [], [], []
                for i, text in enumerate(table.column("text")):
                    for key in {line_key(x, min_chars) for x in _lines(text)} - {None}:
                        hi.append(key[0])
                        lo.append(key[1])
                        owner.append(i)
                owners = table.drop_columns("text").take(pa.array(owner, pa.int64()))
                refs = pa.table({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "doc_id": owners.column("doc_id"), "n": pa.array(np.ones(len(hi), np.int64))})
                if how is not None:
                    refs = refs.append_column("chunk", owners.column("chunk"))
                if filters is not None:
                    refs = refs.filter(pa.array(filters.value.contains(refs.column("hi").to_numpy(), refs.column("lo").to_numpy())))
                yield from refs.to_batches()

    if how is None:
        return docs.select("doc_id", "text").mapInArrow(run, REFS)
    return docs.select("doc_id", "text", chunks.chunk_of(how)).mapInArrow(run, PLACED)


def merge_refs(refs: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The references after whole documents came (`inserted`) or went (`deleted`), both as line_refs."""
    every = refs
    if inserted is not None:
        every = every.unionByName(inserted)
    if deleted is not None:
        every = every.unionByName(deleted.withColumn("n", -F.col("n")))
    return every.groupBy("hi", "lo", "doc_id").agg(F.sum("n").alias("n")).where("n <> 0")


def totals(refs: DataFrame) -> DataFrame:
    """The exact table: per key the documents that hold it and the largest doc_id. Map-side sums keep hot keys small."""
    return refs.groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("last"))


def changed_totals(exact: DataFrame, refs: DataFrame, changes: DataFrame) -> DataFrame:
    """The exact table after the references became `refs`; only keys of `changes` (the references that came or went) are
    counted again."""
    keys = changes.select("hi", "lo").distinct()
    return exact.join(keys, ["hi", "lo"], "left_anti").unionByName(totals(refs.join(keys, ["hi", "lo"], "left_semi")))


def active(exact: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    return exact.where(F.col("n_docs") >= min_docs).select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), "hi", "lo", "last", "n_docs")


def affected(refs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The doc_ids with a line that drops or stays otherwise once the active keys `before` became `after`."""
    old, new = (k.select("hi", "lo", F.struct("last").alias(name)) for k, name in ((before, "old"), (after, "new")))
    keys = old.join(new, ["hi", "lo"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("hi", "lo")
    return refs.join(keys, ["hi", "lo"], "left_semi").select("doc_id").distinct()


def _state(shard: int, keys: pa.Table, filter_: CuckooFilter) -> pa.Table:
    hi, lo, last = _arrays(keys)
    order = np.lexsort((lo, hi))
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": [filter_.dump()], "hi": [hi[order].tobytes()], "lo": [lo[order].tobytes()], "last": [last[order].tobytes()]})


def _arrays(keys: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keys.column("hi").to_numpy(), keys.column("lo").to_numpy(), keys.column("last").fill_null(_NO_ID).to_numpy()


def build(keys: DataFrame) -> DataFrame:
    """A row per shard: its filter and its exact table of active keys (from `active`)."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        hi, lo, _ = _arrays(table)
        return _state(key[0].as_py(), table, CuckooFilter.built(hi, lo))

    return keys.groupBy("shard").applyInArrow(chunks.tidy(one), STATE)


def update(states: DataFrame, keys: DataFrame) -> DataFrame:
    """The shards after the active keys became `keys`: only keys that crossed the limit touch the filters."""

    def one(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        hi, lo, _ = _arrays(new)
        if not old.num_rows:
            return _state(key[0].as_py(), new, CuckooFilter.built(hi, lo))
        before = _load(old)
        was = set(zip(before[1].tolist(), before[2].tolist()))
        now = set(zip(hi.tolist(), lo.tolist()))
        filter_ = before[0]
        gone, come = (np.array(sorted(x), dtype=np.int64).reshape(-1, 2) for x in (was - now, now - was))
        try:
            filter_.delete(gone[:, 0], gone[:, 1])
            filter_.insert(come[:, 0], come[:, 1])
        except Full:
            filter_ = CuckooFilter.built(hi, lo)
        return _state(key[0].as_py(), new, filter_)

    return states.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(chunks.tidy(one), STATE)


def _load(table: pa.Table) -> tuple[CuckooFilter, np.ndarray, np.ndarray, np.ndarray]:
    row = table.slice(0, 1).to_pylist()[0]
    return CuckooFilter.load(row["filter"]), *(np.frombuffer(row[c], dtype=np.int64) for c in ("hi", "lo", "last"))


def broadcast_filters(states: DataFrame, shards: int, most: int = FILTER_BYTES) -> Broadcast | None:
    """All filters in one broadcast, if they have at most `most` bytes."""
    size = states.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size > most:
        return None
    found = {r.shard: CuckooFilter.load(r.filter) for r in states.select("shard", "filter").collect()}
    return states.sparkSession.sparkContext.broadcast(FilterSet([found.get(i, CuckooFilter.sized(0)) for i in range(shards)]))


def probed(refs: DataFrame, states: DataFrame, shards: int) -> DataFrame:
    """The references that the filters let pass, each probed in its shard."""
    salt = F.pmod(F.xxhash64(*refs.columns), F.lit(SALTS)).cast("int").alias("salt")
    own = refs.columns
    asked = refs.select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), salt, *own)
    spread = states.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def probe(asked: pa.Table, state: pa.Table) -> pa.Table:
        out = asked.select(own)
        if not state.num_rows or not asked.num_rows:
            return out.slice(0, 0)
        filter_ = CuckooFilter.load(state.column("filter")[0].as_py())
        return out.filter(pa.array(filter_.contains(out.column("hi").to_numpy(), out.column("lo").to_numpy())))

    return asked.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(chunks.tidy(probe), refs.schema)


def lookup(passed: DataFrame, exact: DataFrame) -> DataFrame:
    """The (doc_id, hi, lo) whose lines drop, with their chunk if they have one, of references that the filters let pass, by
    the exact table's active keys."""
    key = F.struct("hi", "lo").alias("key")
    keys = exact.select(key, "last", "n_docs")
    hot = hot_keys(keys, "key", "n_docs", keys.agg(F.sum("n_docs")).first()[0])
    own = [c for c in passed.columns if c in ("doc_id", "chunk")]
    found = spread_join(passed.select(*own, key), keys.select("key", "last"), "key", hot, "inner")
    return found.where(F.col("last").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))).select(*own, "key.hi", "key.lo")


def placed_keys(docs: DataFrame, dropped: DataFrame, how: chunks.Deal, min_chars: int = MIN_CHARS) -> DataFrame:
    """The (doc_id, hi, lo) that drop, in the chunks whose rows hold them."""
    of = dropped.select("hi", "lo", F.col("doc_id").alias("of"))
    refs = line_refs(docs, min_chars, how=how)
    same = (refs["hi"] == of["hi"]) & (refs["lo"] == of["lo"]) & refs["doc_id"].eqNullSafe(of["of"])
    return refs.join(of, same, "left_semi").select("doc_id", "chunk", "hi", "lo")


def drop_lines(docs: DataFrame, dropped: DataFrame, min_chars: int = MIN_CHARS, how: chunks.Deal | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row, and its other columns in the struct `row`. `dropped` has the keys'
    chunks, dealt as in `how`, or they are looked up."""
    how = how or chunks.deal(docs)
    keys = dropped if "chunk" in dropped.columns else placed_keys(docs, dropped, how, min_chars)
    rows = chunks.dealt(docs, how, "doc_id", "text", others(docs))

    def run(texts: pa.Table, keys: pa.Table) -> pa.Table:
        gone: dict[int | None, set[tuple[int, int]]] = {}
        for doc, *key in zip(*(keys.column(c).to_pylist() for c in ("doc_id", "hi", "lo"))):
            gone.setdefault(doc, set()).add(tuple(key))
        n_lines, n_dropped, kept_text = [], [], []
        for doc, text in zip(texts.column("doc_id").to_pylist(), texts.column("text")):
            lines = kept = _lines(text)
            if doc in gone:
                kept = [x for x in lines if line_key(x, min_chars) not in gone[doc]]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            kept_text.append(b"\n".join(kept).decode())
        return pa.table({"doc_id": texts.column("doc_id"), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_text": pa.array(kept_text, pa.string()), "row": texts.column("row")})

    schema = T.StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_text string").add("row", rows.schema["row"].dataType)
    return rows.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(chunks.tidy(run), schema)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None, filter_bytes: int = FILTER_BYTES, how: chunks.Deal | None = None) -> DataFrame:
    """Build the index over the documents and apply its decisions to them."""
    how = how or chunks.deal(docs)
    shards = shards or how.buckets
    exact = written(active(totals(line_refs(docs, min_chars)), shards, min_docs), "active_lines")
    states = written(build(exact), "line_filters")
    filters = broadcast_filters(states, shards, filter_bytes)
    passed = line_refs(docs, min_chars, filters, how) if filters is not None else probed(line_refs(docs, min_chars, how=how), states, shards)
    return drop_lines(docs, lookup(passed, exact), min_chars, how)


def without_lines(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, without the lines that drop."""
    return restored(line_dedup(docs), docs, "kept_text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256("kept_text").alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, i, x, translate(regexp_replace(regexp_replace(x, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
hot AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id < last) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN hot USING (k) GROUP BY doc_id
"""
