"""Hard negatives by one-dimensional distance keys: exact searches for the highest inner products, without a full scan.

Steps:

1. Vectors become whole numbers and are augmented by one coordinate, sqrt(M^2 - |x|^2) with M the largest length, so that
   the rows with the highest inner products with an anchor are those nearest to it: d^2 = |a|^2 + M^2 - 2 a.x.
2. Pivots are fitted on a sample (SAMPLE rows, about). Every row is stored by the key (nearest pivot, distance to it), in
   shards that are ranges of this key, so equal and near vectors are spread over as many shards as they fill.
3. A search first scans the shard that holds the anchor's own key. By the triangle inequality a row at distance y from a
   pivot that is x away from the anchor is no nearer than |x - y| and no farther than x + y, so what an anchor has found
   bounds the annuli around the pivots that can still matter. Shards whose annuli lie within that distance are scanned
   next; an anchor that has not enough yet doubles its distance. It ends when no annulus is left within the bound: then
   the first k are proven, and all rows were considered.
4. Inside a shard, keys are scanned in blocks that expand around the anchors' own keys, with the same bounds.

Anchors and shards meet by shard, some rows per anchor and shard come back; no pair of rows is ever listed. Of equal vectors
with one label only the first few by vec_id can be among the first k of any search, so no more are kept (a fold, not a
cap: `copies`).

Defined results: rows with a null label or vector, or a null or non-finite component take no part; a null vec_id is no
anchor and comes last among ties; rows that repeat vec_id, label and vector count once; rows of an anchor's vec_id are none
of its positives or negatives; vectors of other lengths count as filled up with zeros; an anchor without positives, and a
positive whose score is below zero or without negatives in the band, give no row; an empty table gives an empty one; other
columns are ignored. Components must lie below 2**31 after scaling and scores below 2**53, else ValueError.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import chunks
from tidemark.llm.shared import written

POSITIVES, NEGATIVES = 5, 10
#: Rows that pivots are fitted on, about; pivots; rows of a shard; shards at most; rows of a block.
SAMPLE, PIVOTS, SHARD, SHARDS, BLOCK = 4_096, 64, 16_384, 4_096, 512
#: Anchors that one task takes; more are dealt over several tasks, each with the shard's rows.
ANCHORS = 65_536
#: How far anchors that have not enough search, round by round, as a share of the largest length; 2 is all there is.
REACHES = (0.5, 1.0, 2.0)
_NO_ID, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: An anchor, and what it wants: the first k rows with a score of low to cap (null: any).
WANTS = "array<struct<want:int,cap:long,low:long>>"
_SENT = "key long, vec_id long, label int, v array<int>, wants array<struct<want:int,cap:long,low:long,bound:long>>"


# --- vectors


def prepared(rows: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each once, with components floor(256 x)."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    some = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    return some.select(F.col("vec_id").cast("long"), label.cast("int").alias("label"), whole.alias("v")).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles (whole numbers), filled up with zeros."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = np.asarray(array.flatten(), dtype=np.float64), np.diff(np.asarray(array.offsets))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _augmented(x: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack((x, last))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """All distances between rows of both."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def fitted(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Cluster centres of the sample: farthest points first, then a few rounds of k-means."""
    if not len(sample):
        return sample
    centres = sample[:1]
    nearest = _distances(sample, centres)[:, 0]
    while len(centres) < min(pivots, len(sample)) and nearest.max() > 0:
        centres = np.vstack((centres, sample[nearest.argmax()]))
        nearest = np.minimum(nearest, _distances(sample, centres[-1:])[:, 0])
    for _ in range(5):
        own = _distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)]).reshape(len(centres), -1)
    return centres


# --- the index


@dataclasses.dataclass
class Keys:
    """What tasks know of the index: the pivots, and for each run of a pivot in a shard the range of its distances."""

    width: int
    most: float
    pivots: np.ndarray
    shard: np.ndarray = dataclasses.field(default_factory=lambda: np.zeros(0, np.int64))
    pivot: np.ndarray = dataclasses.field(default_factory=lambda: np.zeros(0, np.int64))
    low: np.ndarray = dataclasses.field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = dataclasses.field(default_factory=lambda: np.zeros(0))

    @property
    def slack(self) -> float:
        """More than the error of any distance."""
        return 1e-6 * (1 + math.sqrt(self.most))

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from anchors of these squared lengths the rows with a score lie."""
        return np.sqrt(np.maximum(square + self.most - 2.0 * score, 0))

    def keyed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each row's nearest pivot and its distance to it."""
        for batch in batches:
            away = _distances(_augmented(_matrix(batch.column("v"), self.width), self.most), self.pivots)
            near = away.argmin(axis=1) if len(away) else np.zeros(0, np.int64)
            key = [pa.array(near, pa.int32()), pa.array(away[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *key], names=["vec_id", "label", "v", "pivot", "distance"])

    def sent(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard that an anchor has to scan now: its own at first (seen is null), then those whose annuli lie
        up to `upto` away and were not `seen`, unless all they hold has a score above every cap."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                away = _distances(_augmented(_matrix(some.column("v"), self.width), self.most, query=True), self.pivots)
                near = away.argmin(axis=1)
                home = self._home(near, away[np.arange(len(near)), near])
                away = away[:, self.pivot]
                least, far = _annulus(away, self.low, self.high)
                number = lambda name: some.column(name).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                seen, low_enough = number("seen"), far >= number("from") - self.slack
                own = np.arange(len(self.shard)) == home[:, None]
                at_first = np.isnan(seen)
                wanted = np.where(at_first, own, low_enough & (least <= number("upto") + self.slack))
                before = ~at_first & (own | low_enough & (least <= seen + self.slack))
                shards = lambda runs: np.unique(np.column_stack((np.nonzero(runs)[0], self.shard[np.nonzero(runs)[1]])), axis=0).tolist()
                visited = set(map(tuple, shards(before)))
                pairs = [x for x in shards(wanted) if tuple(x) not in visited]
                rows = pa.array([x[0] for x in pairs], pa.int64())
                names = ["key", "vec_id", "label", "v", "wants"]
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in pairs], pa.int32()), *(some.column(c).take(rows) for c in names)], names=["shard", *names])

    def _home(self, pivot: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The run that holds, or lies next to, each key."""
        gap = np.maximum(np.maximum(self.low[None, :] - distance[:, None], distance[:, None] - self.high[None, :]), 0)
        return np.where(self.pivot[None, :] == pivot[:, None], gap, gap + 1e300).argmin(axis=1)

    def scanned(self, queries: pa.Table, rows: pa.Table, k: int, same: bool) -> pa.Table:
        """The first k that each want has in a shard."""
        out = [pa.table({"key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "want": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})]
        if queries.num_rows and rows.num_rows:
            shard = _Shard(self, rows)
            out += [shard.first(queries.slice(at, 256), k, same) for at in range(0, queries.num_rows, 256)]
        return pa.concat_tables(out)


def _annulus(away: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distances of anchors, so far away from the pivots, to rows whose distances to them are low to high."""
    return np.maximum(np.maximum(low[None, :] - away, away - high[None, :]), 0), away + high[None, :]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(_NO_ID).to_numpy()


class _Shard:
    """The rows of a shard by key, in blocks of one pivot."""

    def __init__(self, keys: Keys, rows: pa.Table):
        self.keys = keys
        pivot, distance, ids = rows.column("pivot").to_numpy(), rows.column("distance").to_numpy(), _ids(rows.column("vec_id"))
        order = np.lexsort((ids, distance, pivot))
        pivot, distance = pivot[order], distance[order]
        self.ids, self.labels = ids[order], rows.column("label").to_numpy()[order]
        self.x = _matrix(rows.column("v"), keys.width)[order]
        edges = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1], [True])))
        cuts = sorted({*edges.tolist(), *(c for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for c in range(a, b, BLOCK))})
        self.starts, self.ends = np.array(cuts[:-1]), np.array(cuts[1:])
        self.pivot, self.low, self.high = pivot[self.starts], distance[self.starts], distance[self.ends - 1]

    def first(self, queries: pa.Table, k: int, same: bool) -> pa.Table:
        keys = self.keys
        q = _matrix(queries.column("v"), keys.width)
        square, label, own = np.einsum("ij,ij->i", q, q), queries.column("label").to_numpy(), _ids(queries.column("vec_id"))
        wants = queries.column("wants").combine_chunks()
        row, flat = np.repeat(np.arange(len(q)), np.diff(np.asarray(wants.offsets))), wants.flatten()
        number = lambda name, none: flat.field(name).fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
        cap, floor = number("cap", _NO_ID), np.maximum(number("low", _LEAST), number("bound", _LEAST))
        reach = lambda score: np.where(score == _LEAST, np.inf, keys.radius(square[row], score.astype(np.float64)))
        beyond, need = np.where(cap == _NO_ID, 0, keys.radius(square[row], cap.astype(np.float64))), reach(floor)
        score, ids = np.full((len(row), k), _LEAST), np.full((len(row), k), _NO_ID)
        least, far = _annulus(_distances(_augmented(q, keys.most, query=True), keys.pivots)[:, self.pivot], self.low, self.high)
        for block in np.argsort(least.mean(axis=0), kind="stable"):
            live = np.flatnonzero((least[row, block] <= need + keys.slack) & (far[row, block] >= beyond - keys.slack))
            if not len(live):
                continue
            at, m = slice(self.starts[block], self.ends[block]), int(self.ends[block] - self.starts[block])
            used, place = np.unique(row[live], return_inverse=True)
            s = np.rint(q[used] @ self.x[at].T).astype(np.int64)[place]
            alike = self.labels[at][None, :] == label[row[live]][:, None]
            fits = (alike if same else ~alike) & (s <= cap[live, None]) & (s >= floor[live, None])
            fits &= (self.ids[at][None, :] != own[row[live]][:, None]) | (self.ids[at] == _NO_ID)[None, :]
            some = fits.any(axis=1)
            if not some.any():
                continue
            live, s, fits = live[some], s[some], fits[some]
            # one number that orders by score, then by vec_id
            by_id = np.argsort(self.ids[at], kind="stable")
            rank = np.empty(m, np.int64)
            rank[by_id] = np.arange(m)
            both = np.where(fits, s * m + (m - 1 - rank), _LEAST)
            top = np.partition(both, m - k, axis=1)[:, m - k :] if m > k else both
            new = np.where(top == _LEAST, _LEAST, top // m)
            new_ids = np.where(top == _LEAST, _NO_ID, self.ids[at][by_id[m - 1 - top % m]])
            every, every_ids = np.concatenate((score[live], new), axis=1), np.concatenate((ids[live], new_ids), axis=1)
            order = np.lexsort((every_ids, ~every), axis=1)[:, :k]
            score[live], ids[live] = np.take_along_axis(every, order, 1), np.take_along_axis(every_ids, order, 1)
            floor[live] = np.maximum(floor[live], score[live, k - 1])
            need[live] = reach(floor)[live]
        r, c = np.nonzero(score != _LEAST)
        found = pa.array(ids[r, c], mask=ids[r, c] == _NO_ID)
        who = pa.array(row[r])
        return pa.table({"key": queries.column("key").take(who), "vec_id": queries.column("vec_id").take(who), "want": flat.field("want").take(pa.array(r)), "score": pa.array(score[r, c]), "id": found})


class Index:
    """All rows stored by (pivot, distance)."""

    def __init__(self, rows: DataFrame, copies: int, sample: int = SAMPLE, pivots: int = PIVOTS, shard: int = SHARD):
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        size = rows.agg(F.count("*").alias("many"), F.max(square).alias("most"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top")).first()
        if (size.top or 0) >= 1 << 31 or (size.most or 0) >= 1 << 53:
            raise ValueError(f"components up to {size.top}, squared lengths up to {size.most}")
        rows = rows.withColumn("v", F.col("v").cast("array<int>"))
        part = math.ceil(min(sample / max(size.many, 1), 1) * (1 << 20))
        some = rows.where(F.pmod(F.xxhash64("v", "vec_id"), F.lit(1 << 20)) < part).select("v").toArrow()
        width, most = max(size.width or 0, 1), float(size.most or 0)
        self.keys = Keys(width, most, fitted(_augmented(_matrix(some.column("v"), width), most), pivots))
        if not len(self.keys.pivots):
            self.keys.pivots = np.zeros((1, width + 1))
        self.parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, min(max(math.ceil(size.many / shard), min(self.parts, size.many // 1024)), SHARDS))
        of_equal = Window.partitionBy("label", "v").orderBy(F.asc_nulls_last("vec_id"))
        kept = rows.withColumn("_n", F.row_number().over(of_equal)).where(F.col("_n") <= copies).drop("_n")
        keyed = kept.mapInArrow(self.keys.keyed, "vec_id long, label int, v array<int>, pivot int, distance double")
        self.rows = written(keyed.repartitionByRange(shards, "pivot", "distance", "vec_id").withColumn("shard", F.spark_partition_id()), "index")
        runs = self.rows.groupBy("shard", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("shard", "pivot").collect()  # a row a shard, and one more a pivot
        self.keys.shard, self.keys.pivot = (np.array([r[i] for r in runs], dtype=np.int64) for i in (0, 1))
        self.keys.low, self.keys.high = (np.array([r[i] for r in runs], dtype=np.float64) for i in (2, 3))

    def search(self, queries: DataFrame, k: int, same: bool, batch: int = ANCHORS) -> DataFrame:
        """The first k of each want, as (key, vec_id, want, best: array of (score, id)); a want without any has no row.

        `queries` are (key, vec_id, label, v, wants: WANTS); a want takes rows of its anchor's label if `same`, else of others."""
        keys, spark = self.keys, queries.sparkSession
        radius = lambda score: F.when(score.isNotNull(), F.sqrt(F.greatest(F.col("square") + F.lit(keys.most) - 2 * score.cast("double"), F.lit(0.0))))
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        queries = written(queries.withColumn("square", square).withColumn("from", F.array_min(F.transform("wants", lambda w: F.coalesce(radius(w["cap"]), F.lit(0.0))))), "queries")
        found = spark.createDataFrame([], "key long, vec_id long, want int, best array<struct<score:long,id:long>>")
        if not len(keys.shard):
            return found
        pieces = max(1, math.ceil(queries.count() / batch))
        piece = F.pmod(F.xxhash64("key"), F.lit(pieces)).cast("int")
        seen = queries.select("key", "vec_id", F.lit(None).cast("double").alias("upto"))
        for reach in (None, *REACHES):
            # the k-th score bounds what is left of a want
            full = found.where(F.size("best") == k).select("key", "vec_id", F.struct("want", F.get("best", F.lit(k - 1))["score"].alias("bound")).alias("b"))
            bounds = full.groupBy("key", "vec_id").agg(F.map_from_entries(F.collect_list("b")).alias("bounds"))
            state = queries.join(bounds, ["key", "vec_id"], "left").join(seen.withColumnRenamed("upto", "seen"), ["key", "vec_id"])
            state = state.withColumn("wants", F.transform("wants", lambda w: w.withField("bound", F.try_element_at("bounds", w["want"]))))
            far = F.lit((reach or 0) * math.sqrt(keys.most))
            upto = F.array_max(F.transform("wants", lambda w: F.least(F.coalesce(radius(w["bound"]), far), F.coalesce(radius(w["low"]), F.lit(float("inf"))))))
            state = written(state.select("key", "vec_id", "label", "v", "wants", "from", "seen", upto.alias("upto")), "state")
            sent = written(state.mapInArrow(keys.sent, f"shard int, {_SENT}"), "sent")
            seen = state.select("key", "vec_id", F.greatest("seen", "upto").alias("upto") if reach is not None else F.lit(-1e300).alias("upto"))
            if sent.isEmpty():
                if reach is not None and state.where(F.exists("wants", lambda w: w["bound"].isNull())).isEmpty():
                    break
                continue
            rows = self.rows.join(F.broadcast(sent.select("shard").distinct()), "shard", "left_semi")  # SHARDS rows at most
            rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))) if pieces > 1 else rows.withColumn("piece", F.lit(0))
            both = sent.withColumn("piece", piece).groupBy("shard", "piece").cogroup(rows.groupBy("shard", "piece"))
            new = both.applyInArrow(_scanner(keys, k, same), "key long, vec_id long, want int, score long, id long")
            old = found.select("key", "vec_id", "want", F.explode("best").alias("b")).select("key", "vec_id", "want", "b.*")
            by_score = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("n"), "id")))
            best = F.transform(F.slice(by_score, 1, k), lambda b: F.struct((-b["s"]).alias("score"), b["id"].alias("id")))
            found = written(old.unionByName(new).groupBy("key", "vec_id", "want").agg(best.alias("best")), "found")
        return found


def _scanner(keys: Keys, k: int, same: bool):
    return chunks.tidy(lambda queries, rows: keys.scanned(queries, rows, k, same))


# --- mining


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = (30, 90), batch: int = ANCHORS, **options) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are the first `positives` other rows of an anchor's label; the negatives of each are the first `negatives` rows
    of other labels whose score is within the band, in hundredths of the positive's."""
    rows = written(prepared(vectors, label), "vectors")
    index = Index(rows, max(positives + 1, negatives), **options)
    chosen = rows.where(anchors).select(F.xxhash64("vec_id", "label", "v").alias("key"), "vec_id", "label", F.col("v").cast("array<int>").alias("v"))
    any_ = F.from_json(F.lit('[{"want":0}]'), WANTS)
    near = index.search(chosen.withColumn("wants", any_), positives, True, batch).select("key", "vec_id", "best")
    # of a positive with score s, whole scores of ceil(low * s / 100) to floor(high * s / 100)
    low, high = band
    whole = lambda x: f"({x} - pmod({x}, 100)) div 100"
    wants = F.expr(f"transform(best, (b, i) -> named_struct('want', i, 'cap', {whole(f'b.score * {high}')}, 'low', -({whole(f'-b.score * {low}')})))")
    asked = chosen.join(near, ["key", "vec_id"]).withColumn("wants", F.filter(wants, lambda w: w["low"] <= w["cap"])).where(F.size("wants") > 0)
    found = index.search(asked.select("key", "vec_id", "label", "v", "wants"), negatives, False, batch)
    out = found.join(near.withColumnRenamed("best", "of"), ["key", "vec_id"]).select("vec_id", F.get("of", F.col("want")).alias("p"), F.posexplode("best").alias("i", "n"))
    return out.select(F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND n.la <> n.lb AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 10
"""
