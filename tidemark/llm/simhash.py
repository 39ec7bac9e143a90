"""SimHash near-dedup: 64-bit fingerprints of shingles, joined exactly within a Hamming distance by vantage-point trees.

Steps:

1. A fingerprint bit is set if it is set in over half the XXH64 hashes (seed 42) of a text's four-word shingles, repeats
   included. Equal fingerprints are folded, so what a third of all documents share is one point from here on.
2. A vantage-point tree fitted on a sample of fingerprints (SAMPLE at most, about) deals all of them into shards: at each
   node, points at most `mu` away from the vantage point go inside, the rest outside. By the triangle inequality a pair
   within `radius` can be split only if the inner one lies in the last `radius` distances before `mu`: those points also
   visit the shards beyond the boundary, so each pair meets in the shard of its outer point. Of all splits tried, a node
   takes the one with the fewest points near its boundary.
3. A shard goes on splitting its own points by the same rule until a leaf has LEAF of them, which are compared one by one
   with each other and with the visitors that the bounds let through.
4. A shard answers with a spanning forest of its links, in which no point has more than ARITY children; components over
   the forests of all shards are the result. No pair is ever listed.

Defined results: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; fewer than four words make one shingle of the whole
sequence; null, empty and blank texts have fingerprint zero and are linked like any other; texts of any length are read
whole, PIECE words at a time; rows that repeat a doc_id are linked by their own texts; a null doc_id never is a component's
least id if there is another; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, textbytes
from tidemark.llm.components import components
from tidemark.llm.shared import hot_keys, spread_join, written

WORDS, SEED, RADIUS = 4, 42, 4
#: Points that the tree over the shards is fitted on, about (a quarter of all at most); points of a shard; shards at most.
SAMPLE, SHARD, SHARDS = 65_536, 32_768, 2_048
#: Points of a leaf; vantage points that a node tries; children of a point in a shard's forest.
LEAF, TRIES, ARITY = 128, 8, 16
#: Words that are hashed at a time.
PIECE = 1 << 15


# --- fingerprints


def fingerprints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    data, offsets = textbytes.flatten(column)
    low = textbytes.LOWER[data]
    starts, ends, first = textbytes.spans(low, offsets, textbytes.NOT_SPACE)
    sizes, body = ends - starts + 1, low.tobytes()
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a == b:
            continue
        width = min(WORDS, b - a)
        counts = np.zeros(64, dtype=np.int64)
        for at in range(a, b - width + 1, PIECE):
            stop = min(at + PIECE + width - 1, b)
            joined = b" ".join(body[starts[at] : ends[stop - 1]].split())
            edges = np.concatenate(([0], np.cumsum(sizes[at:stop])))
            counts += _bits([xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in zip(edges[:-width].tolist(), (edges[width:] - 1).tolist())])
        out[i] = np.packbits(2 * counts > b - a - width + 1, bitorder="little").view(np.uint64)[0]
    return out


def _bits(hashes: list[int]) -> np.ndarray:
    """In how many hashes each bit is set."""
    return np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks.slices(pa.Table.from_batches([batch])):
            prints = fingerprints(piece.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").combine_chunks(), pa.array(prints)], names=["doc_id", "print"])


def printed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the fingerprint as a signed number."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_printed, "doc_id long, print long")


# --- vantage-point trees


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def split(points: np.ndarray, radius: int) -> tuple[np.uint64, int]:
    """A vantage point and a distance `mu` that leave the fewest points near the boundary, each side having a quarter of
    them if any split does."""
    some = points if len(points) <= 2048 else points[:: len(points) // 1024]
    best = None
    for vantage in points[:: max(1, len(points) // TRIES)][:TRIES]:
        up_to = np.cumsum(np.bincount(distance(some, vantage), minlength=65))
        for mu in np.flatnonzero((up_to > 0) & (up_to < len(some))).tolist():
            near = up_to[min(mu + radius, 64)] - (up_to[mu - radius] if mu >= radius else 0)
            uneven = 4 * min(up_to[mu], len(some) - up_to[mu]) < len(some)
            score = (uneven, near if not uneven else abs(2 * up_to[mu] - len(some)))
            if best is None or score < best[0]:
                best = score, vantage, mu
    if best is None:  # what was looked at is one point; the rest differs from it
        return points[0], 0
    return best[1], best[2]


@dataclasses.dataclass
class Tree:
    """A node, or a shard."""

    vantage: np.uint64 = np.uint64(0)
    mu: int = 0
    inside: Tree | None = None
    outside: Tree | None = None
    shard: int = 0


def fitted(points: np.ndarray, shards: int, radius: int) -> Tree:
    """A tree whose shards have like numbers of the distinct points."""
    ids = iter(range(shards))

    def grow(points: np.ndarray, shards: int) -> Tree:
        if shards < 2 or len(points) < 2:
            return Tree(shard=next(ids))
        vantage, mu = split(points, radius)
        near = distance(points, vantage) <= mu
        if near.all() or not near.any():
            return Tree(shard=next(ids))
        own = min(shards - 1, max(1, round(shards * np.count_nonzero(near) / len(points))))
        return Tree(vantage, mu, grow(points[near], own), grow(points[~near], shards - own))

    return grow(points, shards)


def sides(home: np.ndarray, visit: np.ndarray, vantage: np.uint64, mu: int, radius: int) -> tuple:
    """Points at home and visiting, inside and outside; of a pair that is split the inner one visits."""
    d, far = distance(home, vantage), distance(visit, vantage)
    inner = d <= mu
    outside = np.concatenate((visit[far > mu - radius], home[inner & (d > mu - radius)]))
    return home[inner], visit[far <= mu + radius], home[~inner], outside


def routed(tree: Tree, home: np.ndarray, visit: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per shard the points that live there and those that visit it."""
    if not len(home) and not len(visit):
        return
    if tree.inside is None:
        yield tree.shard, home, visit
        return
    in_home, in_visit, out_home, out_visit = sides(home, visit, tree.vantage, tree.mu, radius)
    yield from routed(tree.inside, in_home, in_visit, radius)
    yield from routed(tree.outside, out_home, out_visit, radius)


def links(home: np.ndarray, visit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that connect whatever lies within the radius, at least one of each at home."""
    if not len(home):
        return
    if len(home) > LEAF:
        vantage, mu = split(home, radius)
        in_home, in_visit, out_home, out_visit = sides(home, visit, vantage, mu, radius)
        if len(in_home) and len(out_home):
            yield from links(in_home, in_visit, radius)
            yield from links(out_home, out_visit, radius)
            return
    every = np.concatenate((home, visit))
    for at in range(0, len(every), 8192):
        others = every[at : at + 8192]
        for low in range(0, len(home), LEAF):
            own = home[low : low + LEAF]
            yield _near(own, others, np.bitwise_count(own[:, None] ^ others[None, :]) <= radius)


def _near(own: np.ndarray, others: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block, or as few as connect the same points if they are many."""
    if np.count_nonzero(hit) <= 4 * sum(hit.shape):
        a, b = np.nonzero(hit)
        return own[a], others[b]
    label, none = np.arange(len(own)), len(own)
    while True:
        across = np.where(hit, label[:, None], none).min(axis=0)
        low = np.minimum(np.where(hit, across[None, :], none).min(axis=1), label)
        if (low == label).all():
            break
        label = low
    some = across < none
    return np.concatenate((own, others[some])), np.concatenate((own[label], own[across[some]]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, parent) that connect what the pairs connect; no point has more than ARITY children."""
    points, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(points))
    while True:
        before, low = label, np.minimum(label[a], label[b])
        label = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
    first = np.repeat(starts, np.diff(np.concatenate((starts, [len(order)])))) if len(order) else starts
    place = np.arange(len(order)) - first
    parent = order[first + (place - 1) // ARITY * (place > 0)]
    return points[order[place > 0]], points[parent[place > 0]]


# --- the join


def _dealer(tree: Tree, radius: int, most: int = 1 << 21):
    """Sends each point to its shard and to those it visits, one row per shard and `most` points sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            blob = lambda parts: np.concatenate(parts).tobytes()
            out = [(s, blob(h), blob(v)) for s, (h, v) in sorted(held.items())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["shard", "home", "visit"])

        for batch in batches:
            points = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, home, visit in routed(tree, points, points[:0], radius):
                at = held.setdefault(shard, ([], []))
                at[0].append(home)
                at[1].append(visit)
                size += len(home) + len(visit)
            if size > most:
                yield rows()
                size = 0
        yield rows()

    return run


def _searcher(radius: int):
    def run(table: pa.Table) -> pa.Table:
        points = lambda name: np.sort(np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column(name)]))
        # pairs are folded now and then, so that a dense group leaves as many edges as it has points
        a, b, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        for x, y in links(points("home"), points("visit"), radius):
            apart = x != y
            if apart.any():
                a.append(x[apart])
                b.append(y[apart])
                held += len(a[-1])
            if held > 1 << 22:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        x, y = forest(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return run


def hamming_links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """From distinct (print) edges (a, b) that connect all that lie within the radius of each other, directly or not."""
    many = points.count()
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(max(math.ceil(many / shard), min(parts, many // 1024)), SHARDS))
    rate = min(0.25, sample / max(many, 1))
    chosen = points.where(F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < math.ceil(rate * (1 << 20))) if shards > 1 else points.limit(0)
    some = np.array(sorted(r[0] for r in chosen.select("print").collect()), dtype=np.int64).view(np.uint64)
    tree = fitted(np.random.default_rng(7).permutation(some), shards, radius)
    sent = points.select("print").mapInArrow(_dealer(tree, radius), "shard int, home binary, visit binary")
    return sent.repartition(max(parts, shards), "shard").groupBy("shard").applyInArrow(chunks.tidy(_searcher(radius)), "a long, b long")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id that links reach)."""
    rows = written(printed(docs), "prints")
    points = written(rows.groupBy("print").agg(F.min("doc_id").alias("own"), F.count("*").alias("documents")), "points")
    found = components(hamming_links(points, radius, shard, sample)).withColumnRenamed("node", "print")
    # one row a point; only those that have company are looked up by the documents
    named = written(points.join(found, "print", "left").where("documents > 1 or label is not null").select("print", "own", "documents", F.coalesce("label", "print").alias("cluster")), "named")
    groups = written(named.groupBy("cluster").agg(F.min("own").alias("least"), F.count("*").alias("points")), "clusters")
    total = groups.agg(F.sum("points")).first()[0]
    least = spread_join(named, groups.select("cluster", "least"), "cluster", hot_keys(groups, "cluster", "points", total)).select("print", "least")
    documents = named.agg(F.sum("documents")).first()[0]
    out = spread_join(rows, least, "print", hot_keys(named, "print", "documents", documents))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.coalesce("least", "doc_id").alias("component_id"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
