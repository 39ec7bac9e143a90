"""The usual stack between a source and its tables: drop what is not wanted, hold back what is not confirmed, index the rest."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changelog
from tidemark.streaming.commits import Commits
from tidemark.streaming.delay import Delay
from tidemark.streaming.ingest import TABLES, Ingest, Settings, Table


class Stack:
    """`keep` is a predicate on a transaction (a struct column): those that it does not keep leave their block, which stays as
    a position. `delay` newer blocks have to confirm a block. Distance to the tip, catching up, statistics and actions are the
    ingest's own (Settings)."""

    def __init__(self, spark: SparkSession, root: str, tables: Sequence[Table] = TABLES, settings: Settings | None = None, delay: int = 0, keep: Callable[[Column], Column] | None = None):
        self.keep = keep
        self.ingest = Ingest(spark, f"{root.rstrip('/')}/tables", tables, settings)
        self.delay = Delay(spark, f"{root.rstrip('/')}/held", delay, self.ingest.process) if delay > 0 else None

    def process(self, batch: DataFrame, batch_id: int, source: str = "") -> None:
        if self.keep is not None:
            kept = F.col("block").withField("txs", F.filter("block.txs", self.keep))
            batch = batch.withColumn("block", F.when(F.col("block").isNotNull(), kept))
        (self.delay or self.ingest).process(batch, batch_id, source)

    def start(self, log: DataFrame, checkpoint: str, available_now: bool = True):
        source = checkpoint.rstrip("/")
        writer = log.writeStream.foreachBatch(lambda batch, i: self.process(batch, i, source)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


class TipFile:
    """An action that keeps the newest block and its tip in a file, written anew whenever it is `every` blocks further on, or
    behind what is written."""

    def __init__(self, spark: SparkSession, folder: str, every: int = 2048):
        self.every = every
        self._commits = Commits(spark, folder)

    def read(self) -> dict | None:
        text = self._commits.read()
        return json.loads(text) if text else None

    def __call__(self, blocks: DataFrame) -> None:
        at = F.struct("seq", "slot_no", "block_hash", "block_no", "tip_block_no")
        newest = blocks.agg(F.max_by(at, "seq").alias("b")).first()["b"]
        known = self.read()
        if newest is None or known is not None and known["block_no"] <= newest.block_no < known["block_no"] + self.every:
            return
        self._commits.write(json.dumps({k: newest[k] for k in ("slot_no", "block_hash", "block_no", "tip_block_no")}))


def with_tips(log: DataFrame) -> DataFrame:
    """A log of positions in which a rollback is followed by a row at the position it goes back to, with the tip known then.

    Each row becomes one or two, inside a stream as well as in a batch; a number of arrival leaves room for the second."""
    to = F.struct((F.col("seq") * 2 + 1).alias("seq"), F.lit("INDEX").alias("op"), F.col("to_slot").alias("slot_no"), F.lit(None).cast("bigint").alias("to_slot"), F.col("tip_block_no").alias("tip_block_no"), F.lit(True).alias("tip_only"))
    own = F.struct((F.col("seq") * 2).alias("seq"), "op", "slot_no", "to_slot", "tip_block_no", F.lit(False).alias("tip_only"))
    return log.select(F.explode(F.when(F.col("op") == "ROLLBACK", F.array(own, to)).otherwise(F.array(own))).alias("r")).select("r.*")


def tips(log: DataFrame) -> DataFrame:
    """The valid positions of such a log: those of blocks, and of rollbacks that later ones left standing."""
    return changelog.valid_rows(with_tips(log))
