"""Queries that every table answers, at a position or at the latest one.

A frame here is a table's valid rows with `slot_no`. `as_of` is a slot; None asks for the latest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import AheadOfLastSync


def until(rows: DataFrame, as_of: int | None) -> DataFrame:
    return rows if as_of is None else rows.where(F.col("slot_no") <= as_of)


def event_at(rows: DataFrame, slot: int) -> DataFrame:
    return rows.where(F.col("slot_no") == slot)


def events_matching(rows: DataFrame, as_of: int | None, predicate: Column | None = None, *mapped: Column) -> DataFrame:
    """All rows up to a position that the predicate keeps, mapped; without either, all events."""
    out = until(rows, as_of)
    out = out if predicate is None else out.where(predicate)
    return out.select(*mapped) if mapped else out


def latest_events(rows: DataFrame, n: int, as_of: int | None = None, *ties: str) -> DataFrame:
    """The n newest rows."""
    return until(rows, as_of).orderBy(F.desc("slot_no"), *ties).limit(n)


def events_from(rows: DataFrame, after: int, as_of: int | None = None) -> DataFrame:
    """Rows after a position and up to another."""
    return until(rows, as_of).where(F.col("slot_no") > after)


def last_event(rows: DataFrame, *columns: str) -> DataFrame:
    """The newest value, whatever the position; one row."""
    best = F.max_by(F.struct("slot_no", *columns), "slot_no").alias("_last")
    return rows.agg(best).select("_last.*")


def hot_and_cold(rows: DataFrame, flush: int) -> tuple[DataFrame, DataFrame]:
    """Rows newer than the flush position, and the rest."""
    return rows.where(F.col("slot_no") > flush), rows.where(F.col("slot_no") <= flush)


def appended(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """A result over both stores."""
    return hot.unionByName(cold)


def synced_only(query: Callable[[], DataFrame], as_of: int | None, last_sync: int | None, partial: bool = False) -> DataFrame:
    """Answers only where the tables have come that far. With `partial` the error carries what they know."""
    if as_of is not None and (last_sync is None or as_of > last_sync):
        raise AheadOfLastSync(f"asked for slot {as_of}, synced to {last_sync}", query() if partial else None)
    return query()


def consistent_point(progress: DataFrame, *tables: str) -> DataFrame:
    """One row: the position at which all the tables can be read together."""
    chosen = progress.where(F.col("table_name").isin(*tables)) if tables else progress
    newest = chosen.groupBy("table_name").agg(F.max("last_sync").alias("last_sync"), F.max("last_stable").alias("last_stable"))
    return newest.agg(F.min("last_sync").alias("last_sync"), F.min("last_stable").alias("last_stable"))


def regrouped(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each position as one sorted list."""
    return rows.groupBy("slot_no").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("events"))
