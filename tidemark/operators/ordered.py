"""Scans over a total order without a global window.

The order's range is cut at approximate quantiles into at most BUCKETS ranges of like numbers of rows, wherever they lie
dense. Each bucket is summed on its own; the sums - one
row a bucket, so at most BUCKETS - are scanned in one small window and broadcast back; inside a bucket a window
partitioned by it does the rest. No task sees more than a bucket's rows, whatever the length of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BUCKETS = 4096
_B = "_bucket"


def bucketed(frame: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """The rows with `_bucket`, ascending with `order` (a whole number; null comes first)."""
    buckets = buckets or max(1, min(BUCKETS, frame.count() // 100_000))
    cuts = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(frame.agg(F.percentile_approx(order, cuts, 10 * buckets)).first()[0] or [])) if cuts else []
    if not edges:
        return frame.withColumn(_B, F.lit(0).cast("bigint"))
    # how many edges lie at or before the row, by halving
    listed = F.array(*map(F.lit, edges)) if len(edges) < 2 else F.lit(edges)
    steps = F.lit([1 << i for i in reversed(range(len(edges).bit_length()))])
    after = lambda at, step: (at + step <= len(edges)) & (F.get(listed, at + step - 1) <= F.col(order))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(after(at, step), at + step).otherwise(at))
    return frame.withColumn(_B, F.when(F.col(order).isNull(), F.lit(-1)).otherwise(place).cast("bigint"))


def scan(
    frame: DataFrame,
    order: str,
    name: str,
    total: Callable[[Column], Column],
    value: Column,
    combine: Callable[[Column, Column], Column],
    reverse: bool = False,
    inclusive: bool = True,
    ties: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Adds `name`: `total` of `value` over all rows up to this one in `order` (or from this one on, if `reverse`).

    `total` is an associative aggregate (F.sum, F.min, F.max), `combine` the same for two columns, null being neutral.
    """
    rows = bucketed(frame, order, buckets).withColumn("_value", value)
    # frames that end at the row grow in one pass; those that start there would be added up anew for every row, so a
    # reverse scan sorts the other way
    way = F.desc if reverse else F.asc
    near = (Window.unboundedPreceding, 0 if inclusive else -1)
    sums = rows.groupBy(_B).agg(total(F.col("_value")).alias("_sum"))
    others = sums.select(_B, total(F.col("_sum")).over(Window.orderBy(way(_B)).rowsBetween(Window.unboundedPreceding, -1)).alias("_others"))
    inside: WindowSpec = Window.partitionBy(_B).orderBy(way(order), *map(way, ties or [])).rowsBetween(*near)
    out = rows.join(F.broadcast(others), _B).withColumn("_own", total(F.col("_value")).over(inside))
    both = F.when(F.col("_own").isNull(), F.col("_others")).when(F.col("_others").isNull(), F.col("_own")).otherwise(combine(F.col("_own"), F.col("_others")))
    return out.withColumn(name, both).drop(_B, "_value", "_own", "_others")


def running_sum(frame: DataFrame, order: str, value: Column, name: str, **options) -> DataFrame:
    return scan(frame, order, name, F.sum, value, lambda a, b: a + b, **options)


def suffix_min(frame: DataFrame, order: str, value: Column, name: str, **options) -> DataFrame:
    """The least value of the rows after this one."""
    return scan(frame, order, name, F.min, value, F.least, reverse=True, inclusive=False, **options)


def previous(frame: DataFrame, order: str, value: Column, name: str, buckets: int | None = None) -> DataFrame:
    """The value of the row just before this one; null for the first. `order` must be unique."""
    rows = bucketed(frame, order, buckets).withColumn("_value", F.struct(value.alias("v")))
    last = rows.groupBy(_B).agg(F.max_by("_value", order).alias("_last"))
    before = last.select(_B, F.last("_last", ignorenulls=True).over(Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy(_B).orderBy(order)
    out = rows.join(F.broadcast(before), _B)
    return out.withColumn(name, F.coalesce(F.lag("_value").over(inside), F.col("_before"))["v"]).drop(_B, "_value", "_before")
