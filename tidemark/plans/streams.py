"""Queries that run a stream to its end over the event chain and return what it left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import fixtures as fx
from tidemark.plans.catalogue import DEPTH, query
from tidemark.sources import chain
from tidemark.sources.shared import new_folder
from tidemark.streaming import ranges
from tidemark.streaming.delay import Delay
from tidemark.streaming.ingest import TABLES, Ingest, Settings
from tidemark.streaming.scans import Scan


def recorded(spark: SparkSession, sf_dir: str, count: int = 4) -> tuple[str, int]:
    """The event chain with its rollbacks as a recorded log of so many parts in order of arrival; its folder, and the files of a
    part."""
    log, blocks = fx.log(spark, sf_dir), fx.blocks(spark, sf_dir)
    n = F.col("b.slot_no")
    block = F.struct(n.alias("slot_no"), "b.block_hash", "b.block_no", "b.epoch_no", F.col("b.ts").cast("double").alias("block_time"), F.col("b.block_no").alias("tip_block_no"), F.lit(None).cast(f"array<{schemas.TX}>").alias("txs"), F.lit(0).cast("bigint").alias("first_tx"))
    rows = log.alias("l").join(blocks.alias("b"), F.col("l.slot_no") == n, "left")
    rows = rows.select("l.seq", "l.op", "l.to_slot", F.when(F.col("l.op") == "INDEX", block).alias("block"))
    folder = new_folder(spark, "log")
    rows.write.parquet(f"{folder}/all")
    return f"{folder}/log", chain.write_in_order(spark, f"{folder}/all", f"{folder}/log", count)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded log as a stream, a part a batch."""
    folder, each = recorded(spark, sf_dir)
    return chain.stream_log(spark, folder, files_per_batch=each)


@query("SELECT slot_no, block_no FROM valid", "valid")
def stream_ingest_availablenow(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "ingest")
    ingest = Ingest(spark, root, TABLES[:1], Settings(depth=DEPTH))
    folder, each = recorded(spark, sf_dir)
    ingest.start(chain.stream_log(spark, folder, files_per_batch=100 * each), f"{root}/_checkpoint").awaitTermination()
    return ingest.table("block_info").select("slot_no", "block_no")


def _through(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The chain's blocks as a stream of files, range by range: what it left of the rows, and its state."""
    rows = fx.blocks(spark, sf_dir).select("slot_no", "epoch_no", F.col("user_id").alias("value"))
    return ranges.run(spark, ranges.recorded(spark, rows))


@query("SELECT slot_no, epoch_no FROM (SELECT *, lag(epoch_no) OVER (ORDER BY slot_no) AS p FROM blocks) WHERE p IS NULL OR p <> epoch_no", "blocks")
def stream_epoch_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.first_of_epoch(*_through(spark, sf_dir))


@query("SELECT slot_no, CAST(sum(user_id) OVER (ORDER BY slot_no) AS BIGINT) AS total FROM blocks", "blocks")
def stream_running_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.running_fold(*_through(spark, sf_dir))


@query(f"SELECT slot_no, block_no FROM valid WHERE slot_no < (SELECT min(slot_no) FROM (SELECT slot_no FROM valid ORDER BY slot_no DESC LIMIT {DEPTH}))", "valid")
def stream_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with its rollbacks, each block held back until DEPTH newer ones confirm it, in 4 batches."""
    root = new_folder(spark, "delayed")
    ingest = Ingest(spark, f"{root}/tables", TABLES[:1], Settings(depth=DEPTH))
    delay = Delay(spark, f"{root}/held", DEPTH, lambda rows, number: ingest.process(rows, number))
    delay.start(_stream(spark, sf_dir), f"{root}/_checkpoint").awaitTermination()
    return ingest.table("block_info").select("slot_no", "block_no")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "scan")
    scan = Scan(spark, root, DEPTH, "cast(block_time as bigint) % 1000")
    scan.start(_stream(spark, sf_dir), f"{root}/_checkpoint").awaitTermination()
    return scan.rows()


@query("SELECT v.slot_no, CAST(sum(ts % 1000) OVER (ORDER BY v.slot_no) AS BIGINT) AS total FROM valid v JOIN blocks b ON b.slot_no = v.slot_no", "blocks", "valid")
def stream_fold_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running fold over the chain with its rollbacks, in 4 batches."""
    return _scanned(spark, sf_dir).select("slot_no", "total")


@query("SELECT slot_no, epoch_no FROM (SELECT v.slot_no, epoch_no, lag(epoch_no) OVER (ORDER BY v.slot_no) AS p FROM valid v JOIN blocks b ON b.slot_no = v.slot_no) WHERE p IS NULL OR p <> epoch_no", "blocks", "valid")
def stream_epochs_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid block of each epoch."""
    return _scanned(spark, sf_dir).where("first_of_epoch").select("slot_no", "epoch_no")
