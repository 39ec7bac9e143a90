"""Files that a lookup can pass by: rows along a space-filling curve, with the range of each file and a Bloom filter.

Rows are dealt by ranges of a Z-order value that interleaves two bits of the key's hash with one of the slot's place between
the first and last slot. A file then holds a rectangle of (key, slot), and a lookup for a key, or for a key and some slots,
touches the files whose rectangles it crosses. Ranges and filters lie in small tables beside the files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the slot's place; the key's hash has twice as many.
SLOT_BITS = 16
#: Bits of a Bloom filter per row, hash functions, and bits in one row of the filters' table (as bitmap_construct_agg has).
BLOOM_BITS, BLOOM_HASHES, BITMAP = 12, 4, 32_768


def key_hash(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - 2 * SLOT_BITS)


def z_order(key: Column, slot: Column, low: int, high: int) -> Column:
    place = F.least(F.greatest(F.floor((slot - low) * (1 << SLOT_BITS) / F.lit(high - low + 1)), F.lit(0)), F.lit((1 << SLOT_BITS) - 1)).cast("bigint")
    h, out = key_hash(key), F.lit(0).cast("bigint")
    for i in range(SLOT_BITS):
        pair = F.shiftright(h, 2 * i).bitwiseAND(F.lit(3).cast("bigint"))
        bit = F.shiftright(place, i).bitwiseAND(F.lit(1).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(pair, 3 * i + 1)).bitwiseOR(F.shiftleft(bit, 3 * i))
    return out


def laid_out(rows: DataFrame, key: str, parts: int, low: int, high: int) -> DataFrame:
    """The rows dealt into files along the curve, in order of key and slot inside each."""
    z = z_order(F.col(key), F.col("slot_no"), low, high)
    return rows.withColumn("_z", z).repartitionByRange(parts, "_z").drop("_z").sortWithinPartitions(key, "slot_no")


def stretches(rows: DataFrame, key: str) -> list[tuple[DataFrame, int]]:
    """The rows in four stretches of the curve, by the first bits of the key's hash, with the number of rows of each; those that
    have none are left out. Dealt one after the other, a shuffle has one of them at a time."""
    at = F.shiftrightunsigned(key_hash(F.col(key)), 2 * SLOT_BITS - 2)
    many = sorted((r["at"], r["count"]) for r in rows.groupBy(at.alias("at")).count().collect())
    return [(rows.where(at == i), n) for i, n in many]


def zones(rows: DataFrame, key: str) -> DataFrame:
    """A row per file of a table that was read back: the ranges of its keys' hashes and slots, and its rows."""
    h = key_hash(F.col(key))
    at = rows.select(F.col("_metadata.file_path").alias("file"), h.alias("h"), "slot_no").groupBy("file")
    return at.agg(F.min("h").alias("low"), F.max("h").alias("high"), F.min("slot_no").alias("first"), F.max("slot_no").alias("last"), F.count("*").alias("rows"))


def _positions(value: Column, bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) for i in range(BLOOM_HASHES)))


def blooms(rows: DataFrame, column: str, most: int) -> DataFrame:
    """A Bloom filter per file over a column, as rows of BITMAP bits; `most` is the rows of the largest file."""
    bits = bloom_size(most)
    at = rows.select(F.col("_metadata.file_path").alias("file"), F.explode(_positions(F.col(column), bits)).alias("p"))
    part = F.floor(F.col("p") / BITMAP).cast("bigint").alias("part")
    return at.groupBy("file", part).agg(F.bitmap_construct_agg(F.col("p") % BITMAP).alias("bits"), F.lit(bits).cast("bigint").alias("size"))


def bloom_size(most: int) -> int:
    return max(1, math.ceil(most * BLOOM_BITS / BITMAP)) * BITMAP


def files_of_key(zone: DataFrame, key, first: int | None, last: int | None) -> list[str]:
    """The files that can have a key between two slots."""
    h = zone.sparkSession.range(1).select(key_hash(F.lit(key))).first()[0]
    found = zone.where((F.col("low") <= h) & (F.col("high") >= h))
    found = found if first is None else found.where(F.col("last") >= first)
    found = found if last is None else found.where(F.col("first") <= last)
    return sorted(r.file for r in found.select("file").collect())


def files_of_value(spark: SparkSession, bloom: DataFrame, value) -> list[str]:
    """The files whose filters have a value; about one in three hundred others do, too."""
    size = bloom.select("size").first()
    if size is None:
        return []
    wanted = [int(p) for p in spark.range(1).select(_positions(F.lit(value), size[0])).first()[0]]
    some = bloom.where(F.col("part").isin(sorted({p // BITMAP for p in wanted})))
    byte = lambda p: F.conv(F.hex(F.substring("bits", p % BITMAP // 8 + 1, 1)), 16, 10).cast("int")
    hits = [F.max(F.when((F.col("part") == p // BITMAP) & (F.shiftright(byte(p), p % 8).bitwiseAND(F.lit(1)) == 1), 1).otherwise(0)) for p in wanted]
    found = some.groupBy("file").agg(*(h.alias(f"h{i}") for i, h in enumerate(hits)))
    return sorted(r.file for r in found.where(" and ".join(f"h{i} = 1" for i in range(len(wanted)))).select("file").collect())
