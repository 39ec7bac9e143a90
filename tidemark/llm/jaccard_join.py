"""N-gram Jaccard join: a size-aware heavy-light join over distinct five-word shingles.

Two documents link when 100 * intersection >= 75 * union. Steps:

1. Exact copies are folded (per task, then per chunk), so a text that a third of all documents share is one set.
2. Shingles are counted over chunks. All sets are ordered by (frequency class, hash), the rarest first, and a set of n
   shingles keeps the part of its first n - ceil(3n/4) + 1 that occur in other sets: two linked sets share one of them.
3. Light sets (n at most the boundary) enumerate the 2-subsets of that prefix, one shingle longer, because linked sets
   share two of those; heavy sets are looked up in the inverted lists of single prefix shingles, which light sets within
   the size ratio join too. The boundary minimises the estimated cost of both parts.
4. Sets with a common key form candidate groups (connected components over one edge per set and key, never pairs).
5. Inside a group sets are verified exactly. A scan of one set finds all its links at once, and scans go on until all
   sets that were not scanned lie in one component: no link between components can then be left. Groups too large for
   one task are scanned by blocks of sets, each against all rows of the group in Spark.

Defined results: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; fewer than five words make one shingle of the
whole sequence; null, empty and blank texts have no set, are linked with nothing and are their own component; rows
with one doc_id and different texts are judged apart; a null doc_id never is a component's least id if there is another;
repeated rows are linked with each other; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, textbytes
from tidemark.llm.components import components
from tidemark.llm.shared import hot_keys, spread_join, written

WORDS = 5
#: Hashes of the sets that one task of step 5 may hold.
GROUP_HASHES = 4_000_000
_SETS = "node long, digest binary, n long, repeated int, scan double, tokens binary, shingles binary"


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a linked set shares at least with a set of n."""
    return (75 * n + 99) // 100


def linked(a, b, common):
    return 100 * common >= 75 * (a + b - common)


def shingle_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    data, offsets = textbytes.flatten(column)
    low = textbytes.LOWER[data]
    starts, ends, first = textbytes.spans(low, offsets, textbytes.NOT_SPACE)
    words = textbytes.word_hashes(low, starts, ends)
    windows = textbytes.rolling(words, WORDS)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            out.append(np.unique(windows[a : b - WORDS + 1]))
        elif b > a:
            out.append(textbytes.rolling(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _folded(chunk_count: int):
    """Distinct texts of a task with their chunk; the chunk follows the text, so copies meet there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep, chunk = [], []
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer()
                if raw is None:
                    continue
                digest = hashlib.md5(raw).digest()
                if digest not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()  # bounded memory; what is sent twice is folded in its chunk
                    seen.add(digest)
                    keep.append(i)
                    chunk.append(int.from_bytes(digest[8:], "little") % chunk_count)
            yield pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(keep, pa.int64())), pa.array(chunk, pa.int32())], names=["text", "chunk"])

    return run


def _distinct(table: pa.Table) -> tuple[list[bytes], pa.ChunkedArray]:
    at: dict[bytes, int] = {}
    for i, text in enumerate(table.column("text")):
        at.setdefault(hashlib.md5(text.as_buffer()).digest(), i)
    return list(at), table.column("text").take(pa.array(list(at.values()), pa.int64()))


def _code(times: np.ndarray) -> np.ndarray:
    """Frequency class: quarter steps of a power of two."""
    return np.minimum(4 * np.log2(times), 255).astype(np.uint8)


def candidate_sets(docs: DataFrame, how: chunks.Deal) -> DataFrame:
    """A row per distinct text: its set's size and, if it has repeated shingles in its prefix, those and the set."""
    buckets = how.buckets
    placed = docs.select("text").mapInArrow(_folded(how.chunks), "text string, chunk int").repartition(how.parts, "chunk")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        sets = shingle_sets(_distinct(table)[1])
        return chunks.blobs(np.unique(np.concatenate(sets)), key[0].as_py(), buckets, "<u4")

    def pick(texts: pa.Table, answers: pa.Table) -> pa.Table:
        digests, column = _distinct(texts)
        sets = shingle_sets(column)
        sizes = np.array([len(s) for s in sets])
        every, which, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        codes = chunks.gather(answers)
        codes = np.where(codes > 0, codes, (times > 1) * 1)[which]
        rows = {"node": [], "digest": digests, "n": sizes, "repeated": [], "scan": [], "tokens": [], "shingles": []}
        at = 0
        for digest, hashes in zip(digests, sets):
            n = len(hashes)
            code = codes[at : at + n]
            at += n
            size = n - needed(n) + min(2, needed(n))
            alone = int(np.count_nonzero(code == 0))
            tokens = np.zeros(0, dtype=np.uint64)
            if n and alone < n - needed(n) + 1:
                head = np.lexsort((hashes, code))[alone:size]
                tokens, code = hashes[head], code[head]
            else:
                code = code[:0]
            rows["node"].append(int.from_bytes(digest[:8], "little", signed=True))
            rows["repeated"].append(len(tokens))
            rows["scan"].append(float(np.sum(1 + code / 4)))
            rows["tokens"].append(tokens.tobytes())
            rows["shingles"].append(hashes.tobytes() if len(tokens) else None)
        return pa.table(rows, schema=_ARROW_SETS)

    sent = placed.groupBy("chunk").applyInArrow(chunks.tidy(send), chunks.BLOBS)
    found = chunks.answer(sent, how, _code, "<u4")
    return placed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(chunks.tidy(pick), _SETS)


_ARROW_SETS = pa.schema([("node", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("repeated", pa.int32()), ("scan", pa.float64()), ("tokens", pa.binary()), ("shingles", pa.binary())])


def boundary(sets: DataFrame) -> int:
    """The size up to which enumerating 2-subsets costs less than scanning inverted lists, summed over all sets.

    A subset costs one row. A list of f entries costs 1 + log2(f) an entry, for the row and its share of the sort.
    """
    step = F.floor(F.log2("n") * 8)
    costs = sets.where("repeated > 0").groupBy(step.alias("step")).agg(F.max("n").alias("n"), F.sum(F.expr("cast(repeated as double) * (repeated - 1) / 2 + 1")).alias("light"), F.sum("scan").alias("heavy"))
    rows = sorted((r.step, r.n, r.light, r.heavy) for r in costs.collect())  # at most a row per eighth of a power of two
    best, at, light, heavy = sum(r[3] for r in rows), 0, 0.0, sum(r[3] for r in rows)
    for _, n, li, he in rows:
        light, heavy = light + li, heavy - he
        if light + heavy < best:
            best, at = light + heavy, n
    return at


def _keys(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for node, n, blob in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens")):
                tokens = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if n > limit or n < 2 or n >= needed(limit + 1):  # single shingles: heavy sets and light ones that may meet them
                    keys.append(textbytes.mix(tokens))
                    owner.append(np.full(len(tokens), node))
                if 2 <= n <= limit:
                    a, b = np.triu_indices(len(tokens), 1)
                    low, high = np.minimum(tokens[a], tokens[b]), np.maximum(tokens[a], tokens[b])
                    keys.append(textbytes.mix(low * np.uint64(0x9E3779B97F4A7C15) ^ textbytes.mix(high)))
                    owner.append(np.full(len(a), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))], names=["key", "node"])

    return run


def candidate_groups(sets: DataFrame, limit: int) -> DataFrame:
    """(node, label): sets that share a key, directly or through others, have one label."""
    listed = sets.where("repeated > 0").select("node", "n", "tokens").mapInArrow(_keys(limit), "key long, node long")
    heads = listed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail").select("key", "head")
    edges = listed.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    return components(edges)


class Links:
    """Union-find over the sets of one group."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.label = np.arange(len(sets))

    def scan(self, i: int, flag: np.ndarray) -> None:
        mine = self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]
        flag[mine] = 1
        common = np.add.reduceat(flag[self.flat], self.starts)
        flag[mine] = 0
        found = np.unique(self.label[linked(self.sizes[i], self.sizes, common)])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def solve(self) -> np.ndarray:
        waiting = np.ones(len(self.sizes), dtype=bool)
        flag = np.zeros(int(self.flat.max()) + 1, dtype=np.int64)
        while True:
            rest = np.flatnonzero(waiting)
            labels, times = np.unique(self.label[rest], return_counts=True)
            if len(labels) < 2:
                return self.label
            apart = rest[self.label[rest] != labels[times.argmax()]]
            self.scan(int(apart[0]), flag)
            waiting[apart[0]] = False


def _verify(table: pa.Table) -> pa.Table:
    """Exact links inside each group of a pack; (node, digest, cluster) of the sets that have a link."""
    labels = table.column("label").to_numpy()
    order = np.argsort(labels, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], labels[order][1:] != labels[order][:-1], [True])))
    blobs, digests = table.column("shingles"), table.column("digest")
    out, cluster = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        rows = order[a:b]
        found = Links([np.frombuffer(blobs[int(r)].as_buffer(), dtype=np.uint64) for r in rows]).solve()
        times = np.bincount(found, minlength=len(rows))
        for r, f in zip(rows, found):
            if times[f] > 1:
                out.append(digests[int(r)].as_py())
                cluster.append(digests[int(rows[f])].as_py())
    return pa.table({"digest": pa.array(out, pa.binary()), "cluster": pa.array(cluster, pa.binary())})


def _scan_blocks(giant: DataFrame, block_hashes: int) -> DataFrame:
    """As Links.solve over groups too large for a task: blocks of sets against all rows of their groups.

    Each round takes the sets that were not scanned and lie outside their group's largest component, up to a block.
    Between near copies a few rounds are enough; a group of sets that do not link needs all its blocks.
    """
    spark = giant.sparkSession
    giant = written(giant, "giant")
    scanned = spark.createDataFrame([], "node long")
    edges = spark.createDataFrame([], "a long, b long")
    first = True
    while True:
        labels = components(edges) if not first else spark.createDataFrame([], "node long, label long")
        state = giant.select("node", "label", "n").join(labels.withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        waiting = state.join(scanned, "node", "left_anti")
        sizes = waiting.groupBy("label", "part").count().groupBy("label").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
        rest = waiting.join(sizes, "label").where("part <> main").select("node", "n")
        block, total = [], 0
        for r in rest.orderBy(F.xxhash64("node")).limit(16 if first else 4096).collect():
            if block and total + r.n > block_hashes:
                break
            block.append(r.node)
            total += r.n
        if not block:
            return labels
        first = False
        taken = spark.createDataFrame([(b,) for b in block], "node long")
        pivots = giant.join(F.broadcast(taken), "node").select("node", "label", "shingles").collect()
        found = giant.select("node", "label", "shingles").mapInArrow(_against(spark.sparkContext.broadcast([tuple(p) for p in pivots])), "a long, b long")
        edges = written(edges.union(found), "links")
        scanned = written(scanned.union(taken), "scanned")


def _against(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = [(node, label, np.frombuffer(blob, dtype=np.uint64)) for node, label, blob in shared.value]
        every = np.concatenate([p[2] for p in pivots])
        owner = np.repeat(np.arange(len(pivots)), [len(p[2]) for p in pivots])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        sizes = np.array([len(p[2]) for p in pivots])
        groups = np.array([p[1] for p in pivots])
        nodes = np.array([p[0] for p in pivots])
        for batch in batches:
            a, b = [], []
            for node, label, blob in zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), batch.column("shingles")):
                mine = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                lo, hi = np.searchsorted(every, mine), np.searchsorted(every, mine, side="right")
                many = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                common = np.bincount(owner[at], minlength=len(pivots))
                hit = linked(sizes, len(mine), common) & (groups == label) & (nodes != node)
                b.extend(nodes[hit].tolist())
                a.extend([node] * int(hit.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def clusters(sets: DataFrame, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """(digest, cluster) of the distinct texts that link with another text."""
    groups = candidate_groups(sets, boundary(sets))
    light = written(sets.where("repeated > 0").select("node", "n").join(groups, "node"), "groups")
    sizes = light.groupBy("label").agg(F.sum("n").alias("size"), F.count("*").alias("many")).where("many > 1")
    sizes = written(sizes, "sizes")
    total, largest = sizes.agg(F.sum(F.when(F.col("size") <= group_hashes, F.col("size"))), F.max("size")).first()
    packs = max(1, math.ceil((total or 0) / 200_000))
    # the sets themselves move twice: to their labels, and to their packs
    members = sets.where("repeated > 0").select("node", "digest", "n", "shingles")
    chosen = light.join(sizes.where(F.col("size") <= group_hashes).select("label"), "label").select("node", "label").distinct()
    small = members.join(chosen, "node").select("label", "digest", "shingles", F.pmod(F.xxhash64("label"), F.lit(packs)).alias("pack"))
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(packs / 32))
    out = small.repartition(parts, "pack").groupBy("pack").applyInArrow(chunks.tidy(_verify), "digest binary, cluster binary")
    if (largest or 0) > group_hashes:
        large = light.join(sizes.where(F.col("size") > group_hashes).select("label"), "label").select("node", "label").distinct()
        giant = members.join(large, "node").select("node", "label", "n", "digest", "shingles")
        labels = _scan_blocks(giant, group_hashes)
        named = giant.select("node", "digest").join(labels, "node")
        heads = named.groupBy("label").agg(F.min("digest").alias("cluster"))
        out = out.unionByName(named.join(heads, "label").select("digest", "cluster"))
    return out


def jaccard_join(docs: DataFrame, group_hashes: int = GROUP_HASHES, how: chunks.Deal | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included)."""
    sets = written(candidate_sets(docs, how or chunks.deal(docs)), "sets")
    rows = written(docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")), "rows")
    # one row per text from here on: its documents, their least id, its set's size and its cluster
    texts = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("many"), F.min("doc_id").alias("own"))
    found = sets.select("digest", "n").join(clusters(sets, group_hashes), "digest", "left").where("n > 0")
    texts = written(texts.join(found.select("digest", "n", F.coalesce("cluster", "digest").alias("cluster")), "digest"), "texts")
    groups = written(texts.groupBy("cluster").agg(F.min("own").alias("least"), F.count("*").alias("texts"), F.sum("many").alias("documents")), "clusters")
    n_texts, n_rows = groups.agg(F.sum("texts"), F.sum("documents")).first()
    hot = hot_keys(groups, "cluster", "texts", n_texts)
    named = spread_join(texts.select("digest", "n", "cluster"), groups.select("cluster", "least"), "cluster", hot).select("digest", "n", "least")
    out = spread_join(rows, named, "digest", hot_keys(texts, "digest", "many", n_rows))
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, of the least doc_id of each component.

    Rows of one doc_id stay or go together, and they stay if one of them leads; rows without an id count as one id, which
    leads where no id is linked. What goes is the shorter list to join with."""
    leads = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("leads")
    gone = jaccard_join(docs).groupBy(F.col("doc_id").alias("_gone")).agg(leads).where("not leads").select("_gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""
