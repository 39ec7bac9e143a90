"""Tables written to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import new_folder


def others(docs: DataFrame) -> Column:
    """Every column but doc_id and text in one struct named `row`, so that no name can clash on the way."""
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("row")


def restored(frame: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of `docs` in their order, with the text taken from the named column and n_chars following it."""
    own = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.length(text).cast("long")}
    return frame.select(*((own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


#: Hot keys of a join are dealt into parts of this share of the rows; fewer than this many keys can be hot.
PIECES = 4096


def hot_keys(counted: DataFrame, key: str, count: str, total: int | None) -> DataFrame:
    """The keys that more than one in PIECES of `total` rows have, with the number of parts to deal each into."""
    share = F.col(count) * PIECES / F.lit(max(total or 0, 1))
    return counted.where(share > 1).select(key, F.ceil(share).cast("int").alias("_parts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """A join with a right side of unique keys, in which no task gets more than one part of a hot key (or of null). `hot`
    comes from hot_keys, so it has under PIECES rows and is broadcast."""
    parts = F.when(F.col(key).isNull(), F.lit(PIECES)).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_salt", every).drop("_parts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
