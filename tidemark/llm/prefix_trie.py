"""Prefix trie of conversations by Patricia construction over sorted sequences.

Steps:

1. A turn becomes the 128-bit digest of its role and text and a count of words; a rebuilt conversation is the sequence of
   its digests. From here on no text moves.
2. Equal sequences are folded. Their conversations are dealt by ranges of (sequence, conv_id), so copies that a third of all
   conversations share lie in many tasks; each range sends its ids as lines, which one task per sequence then hashes one
   after the other, holding one line at a time.
3. The distinct sequences are sorted into shards, ranges of sequences. A shard scans its sequences with a stack and makes
   only the points that matter: branches, ends and leaves, joined by compressed edges.
4. What a node needs is a sum over shards: its members, leaves and children, the words of all members' turns, and the words
   of the nodes below it, each node counted in the shard in which it begins. So only nodes on the border of two shards -
   prefixes that the last sequence of one and the first of the next have in common - are exchanged, summed and sent back.
5. Each shard then expands its edges: an inner node of an edge has the edge's members and leaves, one child, and the edge's
   words from its own turn on (suffix sums).

A subtree's saved tokens are sum((n_convs - 1) * words) over its nodes = the words that its members have from its top on,
less the words of its distinct nodes.

Defined results: turns are in order of their number, null first, and of digests where numbers are equal; null roles and texts
are empty; repeated rows are turns of their own; rows without conv_id belong to no conversation; ids below zero are cut as
SQL cuts them (c - c % 20 lies nearer to zero); an empty table has no node, not even a root; texts of any length are read
whole; other columns are ignored. A conversation takes about 40 bytes a turn in the task that holds it.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import chunks
from tidemark.llm.shared import written

#: Conversations are rebuilt from the head of the first of each GROUP ids, HEADS - 1 turns at most.
GROUP, HEADS = 20, 4
#: Bytes of sequences in a shard; ids in a line; hexadecimal digits of a digest.
SHARD, IDS, DIGITS = 8 << 20, 1 << 16, 32
_CONTEXT = "shard int, side int, depth long, before string, after string, node string, n long, least long, leaves long, children long, total long, fresh long"
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SUMS = ("n", "least", "leaves", "children", "total", "fresh")
_NOBODY = hashlib.sha256(b"").hexdigest()


# --- sequences


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests and words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    one = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("b"), digest.alias("digest"), words.alias("words"))
    known = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), one.alias("t"))
    return known.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """The same with the first h turns of the first conversation of its group in place of its own, h by a hash of the id."""
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("group"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.withColumn("group", group).join(heads, "group", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence in sorted rows, up to IDS conversations at a time, as one row with their ids."""
    at: list = []
    ids: list[int] = []

    def row() -> pa.RecordBatch:
        text = ",".join(map(str, ids))
        return pa.RecordBatch.from_pylist([{"name": at[0], "key": at[1], "words": at[2], "least": ids[0], "n": len(ids), "ids": text}], _ARROW_LINES)

    for batch in batches:
        names, keys, words = (batch.column(c) for c in ("name", "key", "words"))
        for i, (name, conv) in enumerate(zip(names.to_pylist(), batch.column("conv_id").to_pylist())):
            if ids and (name != at[0] or len(ids) == IDS):
                yield row()
                ids = []
            if not ids:
                at = [name, keys[i].as_py(), words[i].as_py()]
            ids.append(conv)
    if ids:
        yield row()


_ARROW_LINES = pa.schema([("name", pa.string()), ("key", pa.string()), ("words", pa.list_(pa.int32())), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each sequence, in order, as one row with the hash of all ids."""
    at, digest, n = None, hashlib.sha256(), 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": at["key"], "words": at["words"], "least": at["least"], "n": n, "ends": digest.hexdigest()}], _ARROW_SEQUENCES)

    for batch in batches:
        for i in range(batch.num_rows):
            name, ids = batch.column("name")[i].as_py(), batch.column("ids")[i].as_py()
            if at is None or at["name"] != name:
                if at is not None:
                    yield row()
                at = {"name": name} | {c: batch.column(c)[i].as_py() for c in ("key", "words", "least")}
                digest, n = hashlib.sha256(ids.encode()), 0
            else:
                digest.update(b"," + ids.encode())
            n += batch.column("n")[i].as_py()
    if at is not None:
        yield row()


_ARROW_SEQUENCES = pa.schema([("key", pa.string()), ("words", pa.list_(pa.int32())), ("least", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def sequences(conversations: DataFrame, parts: int) -> DataFrame:
    """The distinct sequences: key (the digests), words, least conv_id, n conversations, hash of their ids."""
    key = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = written(rows.withColumn("name", F.md5(F.col("key").cast("binary"))), "rebuilt")
    lines = rows.repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_lines, "name string, key string, words array<int>, least long, n long, ids string")
    return lines.repartition(parts, "name").sortWithinPartitions("name", "least").mapInArrow(_hashed, "key string, words array<int>, least long, n long, ends string")


# --- the tree of a shard


def common(a: str, b: str) -> int:
    """How many digests two sequences have in common at their heads."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGITS] == b[: middle * DIGITS]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclasses.dataclass
class Point:
    """A branch, end or leaf: its sequences first..last and their sums; `edge` is the depth of the point above."""

    depth: int
    first: int
    end: int = -1
    last: int = -1
    edge: int = -1
    above: int = -1
    n: int = 0
    least: int = 1 << 63
    leaves: int = 0
    children: int = 0
    total: int = 0
    fresh: int = 0
    below: list[int] = dataclasses.field(default_factory=list)


class Patricia:
    """The points of a shard's sorted distinct sequences, given the sequences just before and after the shard (or None).

    `left` and `right` are the depths up to which the first and last path are nodes of the shard before or after, too."""

    def __init__(self, table: pa.Table, before: str | None, after: str | None):
        table = table.sort_by("key")
        self.keys = table.column("key").to_pylist()
        self.n, self.least, self.ends = table.column("n").to_pylist(), table.column("least").to_pylist(), table.column("ends").to_pylist()
        self.depths = [len(k) // DIGITS for k in self.keys]
        words = table.column("words").combine_chunks()
        # the words up to each depth, sequence by sequence, each with a zero in front
        sizes = np.array(self.depths) + 1
        self.starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), dtype=np.int64)
        flat[np.setdiff1d(np.arange(len(flat)), self.starts, assume_unique=True)] = words.flatten().to_numpy(zero_copy_only=False)
        sums = np.cumsum(flat)
        self.upto = sums - np.repeat(sums[self.starts], sizes)
        self.left = -1 if before is None else common(before, self.keys[0])
        self.right = -1 if after is None else common(self.keys[-1], after)
        self.points: list[Point] = []
        self._scan()

    def words(self, sequence: int, depth: int) -> int:
        return int(self.upto[self.starts[sequence] + depth])

    def _scan(self) -> None:
        stack: list[Point] = []
        for i, key in enumerate(self.keys):
            if i:
                self._close(stack, common(self.keys[i - 1], key), i - 1)
            stack.append(Point(self.depths[i], i, i, n=self.n[i], least=self.least[i], total=self.n[i] * self.words(i, self.depths[i])))
        self._close(stack, -1, len(self.keys) - 1)

    def _close(self, stack: list[Point], depth: int, last: int) -> None:
        """Finishes the points deeper than `depth`; -1 finishes all, with the root above them."""
        while stack and stack[-1].depth > depth:
            point = stack.pop()
            point.last = last
            if not point.below and not (last == len(self.keys) - 1 and self.right >= point.depth):
                point.leaves = 1
            self.points.append(point)
            for child in point.below:
                self.points[child].above = len(self.points) - 1
            if not point.depth:
                continue
            edge = max(depth, 0)
            if not stack or stack[-1].depth < edge:
                stack.append(Point(edge, point.first))
            top = stack[-1]
            point.edge = top.depth
            # what the shard before has begun does not count here
            begun = self.left if point.first == 0 else -1
            top.n, top.least, top.leaves, top.total = top.n + point.n, min(top.least, point.least), top.leaves + point.leaves, top.total + point.total
            top.children += top.depth + 1 > begun
            top.fresh += point.fresh + max(0, self.words(point.first, point.depth) - self.words(point.first, max(top.depth, min(begun, point.depth))))
            top.below.append(len(self.points) - 1)

    def borders(self) -> list[dict]:
        """What the shard adds to the nodes that it shares with the shards next to it, by side and depth."""
        out = []
        for point in self.points:
            low = 0 if point.depth == 0 else point.edge + 1
            for side, shared in ((0, point.first == 0 and self.left), (1, point.last == len(self.keys) - 1 and self.right)):
                for depth in range(low, min(point.depth, shared) + 1 if shared is not False else 0):
                    begun = self.left if point.first == 0 else -1
                    if side == 1 and depth <= begun:
                        continue  # it is on the first path, too
                    own = max(0, self.words(point.first, point.depth) - self.words(point.first, max(depth - 1, 0, min(begun, point.depth))))
                    children = point.children if depth == point.depth else int(depth + 1 > begun)
                    name = hashlib.md5(self.keys[point.first][: depth * DIGITS].encode()).hexdigest()
                    out.append({"side": side, "depth": depth, "node": name, "n": point.n, "least": point.least, "leaves": point.leaves, "children": children, "total": point.total, "fresh": point.fresh + own})
        return out

    def nodes(self, known: dict[tuple[int, int], dict]) -> pa.Table:
        """A row per node that begins here; `known` has the sums of those shared with the shards next to it."""
        points, last = self.points, len(self.keys) - 1
        column = lambda name: np.array([getattr(p, name) for p in points], dtype=np.int64)
        depth, first, above = column("depth"), column("first"), column("above")
        low = np.where(depth == 0, 0, column("edge") + 1)
        low = np.where(first == 0, np.maximum(low, self.left + 1), low)
        many = np.maximum(depth - low + 1, 0)
        at = np.repeat(np.arange(len(points)), many)
        d = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + low[at]
        upto = lambda dep: self.upto[self.starts[first[at]] + np.maximum(dep, 0)]
        n, least, leaves, total = (column(c)[at] for c in ("n", "least", "leaves", "total"))
        children = np.where(d == depth[at], column("children")[at], 1)
        fresh = column("fresh")[at] + upto(depth[at]) - upto(d - 1)
        # the node above, on this edge or at its upper end
        inner = d - 1 >= np.where(depth[at] == 0, 0, column("edge")[at] + 1)
        over = np.where(inner, at, above[at])
        parent = column("least")[over]
        for side, shared, of in ((1, self.right, column("last") == last), (0, self.left, first == 0)):
            depths = sorted(k for s, k in known if s == side and 0 <= (-1 if k is None else k) <= shared)
            if not depths:
                continue
            sums = {c: np.zeros(shared + 2, np.int64) for c in _SUMS}
            there = np.zeros(shared + 2, dtype=bool)
            there[depths] = True
            for c in _SUMS:
                sums[c][depths] = [known[side, k][c] for k in depths]
            here = np.flatnonzero(of[at] & (d <= shared))
            here = here[there[d[here]]]
            for values, c in zip((n, least, leaves, children, total, fresh), _SUMS):
                values[here] = sums[c][d[here]]
            here = np.flatnonzero(of[over] & (d > 0) & (d <= shared + 1))
            here = here[there[d[here] - 1]]
            parent[here] = sums["least"][d[here] - 1]
        saved = total - n * upto(d - 1) - fresh
        end = column("end")[at]
        ends = [self.ends[e] if e >= 0 and top else _NOBODY for e, top in zip(end.tolist(), (d == depth[at]).tolist())]
        rows = [least, d, pa.array(parent, mask=d == 0), n, children, leaves, saved]
        return pa.table([*map(pa.array, rows), pa.array(ends, pa.string())], names=[f.split()[0] for f in _NODES.split(", ")])


def _edges(context: pa.Table) -> tuple[str | None, str | None]:
    row = next(r for r in context.select(["side", "before", "after"]).to_pylist() if r["side"] < 0)
    return row["before"], row["after"]


def _borders(key: tuple, table: pa.Table, context: pa.Table) -> pa.Table:
    found = Patricia(table, *_edges(context)).borders()
    rows = [{"shard": key[0].as_py(), "before": None, "after": None} | r for r in found]
    return pa.Table.from_pylist(rows, _ARROW_CONTEXT)


def _expanded(key: tuple, table: pa.Table, context: pa.Table) -> pa.Table:
    known = {(r["side"], r["depth"]): r for r in context.drop_columns(["before", "after"]).to_pylist()}
    return Patricia(table, *_edges(context)).nodes(known)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_ARROW_CONTEXT = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in _CONTEXT.split(", ")])


# --- the trie


def trie(sequences: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes over distinct sequences (key, words, least, n, ends)."""
    spark = sequences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many, size = sequences.agg(F.count("*"), F.sum(F.length("key") + 64)).first()
    shards = max(1, math.ceil((size or 0) / shard), min(parts, many // 1024))
    # a table, so that a shard stays the same rows whenever it is read
    rows = written(sequences.repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id()), "shards")
    ends = rows.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("shard")  # a row a shard
    null = lambda kind: F.lit(None).cast(kind)
    own = {"side": F.lit(-1), "depth": null("long"), "before": F.lag("last").over(order), "after": F.lead("first").over(order)}
    names = [f.split() for f in _CONTEXT.split(", ")]
    edges = written(ends.select(*(own.get(c, F.col(c) if c == "shard" else null(kind)).cast(kind).alias(c) for c, kind in names)), "edges")
    partial = rows.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(chunks.tidy(_borders), _CONTEXT)
    partial = written(partial, "borders")  # the depth of a path a shard
    sums = partial.groupBy("node").agg(F.min("least").alias("least"), *(F.sum(c).alias(c) for c in _SUMS if c != "least"))
    known = partial.select("shard", "side", "depth", "before", "after", "node").join(sums, "node").select(*(c for c, _ in names))
    return rows.groupBy("shard").cogroup(edges.unionByName(known).groupBy("shard")).applyInArrow(chunks.tidy(_expanded), _NODES)


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = written(turns(conversations), "conversations")
    return trie(written(sequences(rebuilt(own), parts), "sequences"), shard)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS i, m, w FROM (
    SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, n, c - c % 20 AS g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h FROM (SELECT c, max(i) AS n FROM t GROUP BY c)),
r AS (SELECT c.c, t.i AS d, t.m, t.w FROM c JOIN t ON t.c = c.g AND t.i <= c.h
    UNION ALL SELECT c.c, least(c.h, coalesce(b.n, 0)) + t.i - c.h, t.m, t.w FROM c JOIN t ON t.c = c.c AND t.i > c.h LEFT JOIN c b ON b.c = c.g),
path AS (SELECT c, d, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS node, w FROM r UNION ALL SELECT c, 0, '', 0 FROM c),
node AS (SELECT node, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w FROM path GROUP BY node, d),
below AS (SELECT left(node, length(node) - 32) AS node, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN below USING (node)),
sums AS (SELECT a AS node, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT n, w, k, unnest(list_transform(range(0, d + 1), lambda x: left(node, 32 * x))) AS a FROM full_) GROUP BY a),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, d) AS node FROM path GROUP BY c) GROUP BY node)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_ f JOIN sums USING (node) LEFT JOIN ends USING (node) LEFT JOIN node p ON f.d > 0 AND p.node = left(f.node, length(f.node) - 32)
"""
