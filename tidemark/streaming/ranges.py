"""Change of epoch and running fold over a stream whose files hold ranges of an order.

A range lies whole in one file, and a batch takes FILES files at most. Each batch is worked off range by range - a task
sees no more than a range's rows - and leaves its rows with what their own range says, and one summary row a range: its
first slot, last epoch and total. The summaries are the state. They carry epoch and total from range to range when the
result is read, so files may arrive in any order, and a batch that is made again replaces its own rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.shared import new_folder

#: Rows that a range has, about, and files that a batch takes.
ROWS, FILES = 250_000, 16
_SUMMARY = "range int, first long, last_epoch long, sum long"


def recorded(spark: SparkSession, rows: DataFrame, least: int = 4, size: int = ROWS) -> str:
    """The rows (slot_no and more) as files of one range each, of like numbers of rows, with its number; their folder."""
    folder = new_folder(spark, "blocks")
    files = max(least, -(-rows.count() // size))
    rows.repartitionByRange(files, "slot_no").withColumn("range", F.spark_partition_id()).write.parquet(folder)
    return folder


def run(spark: SparkSession, source: str, files: int = FILES) -> tuple[DataFrame, DataFrame]:
    """Streams (slot_no, epoch_no, value, range) to the end; the rows with `_own` (total inside the range) and `_before` (epoch
    of the row before it in the range, as a struct; null for the first), and the summaries."""
    out = new_folder(spark, "state")
    schema = spark.read.parquet(source).schema
    inside = Window.partitionBy("range").orderBy("slot_no")
    value = F.coalesce(F.col("value"), F.lit(0)).cast("long")

    def step(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("_own", F.sum(value).over(inside)).withColumn("_before", F.lag(F.struct(F.col("epoch_no").alias("v"))).over(inside))
        own.write.mode("overwrite").parquet(f"{out}/rows/batch_id={number}")
        sums = batch.groupBy("range").agg(F.min("slot_no").cast("long").alias("first"), F.max_by("epoch_no", "slot_no").cast("long").alias("last_epoch"), F.sum(value).alias("sum"))
        sums.write.mode("overwrite").parquet(f"{out}/summaries/batch_id={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows, spark.read.schema(_SUMMARY).parquet(f"{out}/summaries")


def _carried(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Adds what the earlier ranges leave: `_sum`, and `_last` as a struct (null for the first range)."""
    order = Window.orderBy("first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = summaries.select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("_sum"), F.lag(F.struct(F.col("last_epoch").alias("v"))).over(order).alias("_last"))
    return rows.join(F.broadcast(carry), "range")


def first_of_epoch(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """The rows whose epoch differs from that of the row before them."""
    epoch = F.coalesce(F.col("_before")["v"], F.when(F.col("_before").isNull(), F.col("_last")["v"]))
    return _carried(rows, summaries).where(epoch.isNull() | (epoch != F.col("epoch_no"))).select("slot_no", "epoch_no")


def running_fold(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each row with the total of the values up to it."""
    return _carried(rows, summaries).select("slot_no", (F.col("_own") + F.col("_sum")).alias("total"))
