"""Intervals, and points that ask which of them they stab: many questions in one equi-join.

Slots are the leaves of a binary tree whose nodes are (level, number). An interval is cut into the few nodes that make it up
exactly, two a level at most; a point lies in one node of each level. So a point stabs an interval if, and only if, they share
one node, and they share no second one: the join is on equality, gives each pair once and nothing to filter. A key with
many intervals is spread over its nodes. Where sums are asked for, intervals are added up per node before they are joined,
and no pair is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = ["_level", "_node"]
#: Keys that are asked for and fit a broadcast; points of a key that are looked through one by one, fewer than the nodes of a cover.
ASKED_KEYS, ONE_BY_ONE = 1_000_000, 16


def cover(low: Column, high: Column, levels: int) -> Column:
    """The nodes (level, node) that make up low..high, high itself left out, of whole numbers from 0 on."""
    parts = []
    for k in range(levels):
        first, last = F.shiftright(low + F.lit((1 << k) - 1), k), F.shiftright(high, k)
        some, one = first < last, F.lit(1).cast("bigint")
        node = lambda n: F.struct(F.lit(k).alias("_level"), n.cast("bigint").alias("_node"))  # noqa: B023, E731
        parts += [F.when(some & (first.bitwiseAND(one) == 1), node(first)), F.when(some & (last.bitwiseAND(one) == 1), node(last - 1))]
    return F.array_compact(F.array(*parts))


def path(point: Column, levels: int) -> Column:
    """The nodes that hold a point."""
    return F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright(point, k).cast("bigint").alias("_node")) for k in range(levels)))


def _nodes(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the nodes they lie in. What lies beyond all points is cut off, so an open end (null) is one like others."""
    span = points.agg(F.min(at), F.max(at)).first()
    least, most = (span[0], span[1]) if span[0] is not None else (0, 0)
    levels = max(1, (most - least + 1).bit_length())
    low = F.greatest(F.col(start).cast("bigint") - least, F.lit(0).cast("bigint"))
    high = F.least(F.coalesce(F.col(end).cast("bigint"), F.lit(most + 1)), F.lit(most + 1)) - least
    left = intervals.where(F.col(start).isNotNull()).withColumn("_n", F.explode(cover(low, high, levels))).select("*", "_n.*").drop("_n")
    right = points.where(F.col(at).isNotNull()).withColumn("_n", F.explode(path(F.col(at).cast("bigint") - least, levels))).select("*", "_n.*").drop("_n")
    return left, right


def _asked(points: DataFrame, keys: list[str]) -> tuple[int, int]:
    """How many keys have points, and the points of the key that has most."""
    found = points.groupBy(*keys).count().agg(F.count("*"), F.max("count")).first()
    return found[0], found[1] or 0


def stabbed(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str) -> DataFrame:
    """Each point with each interval start..end (end left out, null: open) of its keys that holds it. Where every key has few
    points, they go to the intervals, which stay where they are; otherwise both meet in the nodes."""
    many, most = _asked(points, keys)
    if many <= ASKED_KEYS and most <= ONE_BY_ONE:
        per_key = points.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in points.columns if c not in keys))).alias("_points"))
        holds = lambda p: (F.col(start) <= p[at]) & (F.col(end).isNull() | (F.col(end) > p[at]))
        rows = intervals.join(F.broadcast(per_key), keys).withColumn("_p", F.explode(F.filter("_points", holds)))
        return rows.select(*keys, "_p.*", *(c for c in intervals.columns if c not in keys))
    left, right = _nodes(intervals, points, start, end, at)
    return right.join(left, [*keys, *_NODE]).drop(*_NODE)


def stabbed_sums(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, **sums: Column) -> DataFrame:
    """Each point with sums over the intervals that hold it; zero where there are none. Points that are alike are one row."""
    if _asked(points, keys)[0] <= ASKED_KEYS:  # what nobody asks for is not taken apart
        intervals = intervals.join(F.broadcast(points.select(*keys).distinct()), keys, "left_semi")
    left, right = _nodes(intervals, points.select(*keys, at).distinct(), start, end, at)
    per_node = left.groupBy(*keys, *_NODE).agg(*(F.sum(value).alias(name) for name, value in sums.items()))
    found = right.join(per_node, [*keys, *_NODE]).groupBy(*keys, at).agg(*(F.sum(name).alias(name) for name in sums))
    out = points.join(found, [*keys, at], "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) for name in sums})
