"""Reading change logs and recorded blocks: batch, file stream, event files by name, and a stream reader with offsets."""

from __future__ import annotations

import dataclasses
import io
import itertools
import json
import os
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TypeVar

from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from tidemark import schemas
from tidemark.errors import InvalidTable, NoIntersection
from tidemark.operators.changelog import valid_rows
from tidemark.operators.ordered import suffix_min
from tidemark.sources import files

T_ = TypeVar("T_")


def read_log(spark: SparkSession, *path: str) -> DataFrame:
    """A recorded log as a batch: the whole stream at once."""
    return spark.read.schema(schemas.STREAM).parquet(*path)


def stream_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A recorded log as a stream; how much a batch takes is bounded by files."""
    return spark.readStream.schema(schemas.STREAM).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_names(spark: SparkSession, path: str, files_per_batch: int = 100, clean: bool = False) -> DataFrame:
    """The files of a recorded log as a stream, a row of `file_name` per row of the log; of the files only the footers are read. A
    batch then reads its files as tables, each time with the columns that it needs. With `clean` the log is the stream's own: the
    files of a batch are deleted once the batch is committed in the checkpoint, so those of the last one stay."""
    stream = spark.readStream.schema(schemas.STREAM).option("maxFilesPerTrigger", files_per_batch).option("cleanSource", "delete" if clean else "off")
    return stream.parquet(path).select("_metadata.file_name")


#: Bytes of a recorded log that make a file of their own, about.
FILE_BYTES = 32 << 20


def write_in_order(spark: SparkSession, source: str, folder: str, count: int, file_bytes: int = FILE_BYTES) -> int:
    """A recorded log in so many parts, one after the other in order of arrival, each of as many files as its size asks for; that
    number. A stream takes files in the order in which they came, so that many files a batch make a part a batch."""
    rows, each = read_log(spark, source), max(1, -(-files.size(spark, source) // (count * file_bytes)))
    # by all that tells rows apart: those of a large block are dealt, too
    return write_parts(rows, folder, count, lambda parts: parts.repartition(count * each, "_part", F.pmod(F.xxhash64("seq", "block.first_tx"), F.lit(each))), each)


def write_parts(rows: DataFrame, folder: str, count: int, dealt: Callable[[DataFrame], DataFrame] = lambda parts: parts, least: int = 1, most: int | None = None) -> int:
    """A log in so many parts, written in one pass by the tasks that have its rows; the files of a part, `least` or more.
    `most` is the largest seq, if it is known. Files then move to the folder part by part, in the order of their times."""
    spark = rows.sparkSession
    most = (rows.agg(F.max("seq")).first()[0] or 0) if most is None else most
    dealt(rows.withColumn("_part", F.expr(f"seq * {count} div {most + 1}L"))).write.options(**files.CODEC).partitionBy("_part").parquet(f"{folder}-parts")
    made = [files.listed(spark, f"{folder}-parts/_part={i}", ".parquet") for i in range(count)]
    each, moved, start = max(least, *map(len, made)), [], int(time.time() * 1000) - 1000 * count
    for i, part in enumerate(made):
        for n in range(each - len(part)):  # there are no files of nothing
            spark.createDataFrame([], schemas.STREAM).repartition(1).write.parquet(f"{folder}-none/{i}-{n}")
            part.append(files.listed(spark, f"{folder}-none/{i}-{n}", ".parquet")[0])
        for n, path in enumerate(part):
            moved.append(f"{folder}/{i:05d}-{n:05d}.parquet")
            files.move(spark, path, moved[-1], start + 1000 * i)
    times = [files.changed(spark, path) for path in moved]
    if times != sorted(times):
        raise OSError(f"the file system of {folder} keeps no order of files")
    files.remove(spark, f"{folder}-parts")
    files.remove(spark, f"{folder}-none")
    return each


def forward_only(log: DataFrame) -> DataFrame:
    return log.where("op = 'INDEX'")


def starting_at(log: DataFrame, slot: int | None) -> DataFrame:
    """From an explicit position on; None is genesis."""
    return log if slot is None else log.where((F.col("op") != "INDEX") | (F.col("block.slot_no") > slot))


def check_start(log: DataFrame, slot: int | None, block_hash: str | None) -> None:
    """Fails unless the log's canonical chain has the block to start from; genesis always is there."""
    if slot is None:
        return
    flat = log.select("seq", "op", F.col("block.slot_no").alias("slot_no"), F.col("block.block_hash").alias("block_hash"), "to_slot")
    found = valid_rows(flat).where((F.col("slot_no") == slot) & (F.lit(not block_hash) | (F.col("block_hash") == block_hash)))
    if found.isEmpty():
        raise NoIntersection(f"the source has no block {block_hash} at slot {slot}")


#: Segments of an index: how many numbers of the order of arrival each has.
EVERY = 10_000
_INDEX = "segment bigint, low bigint, high bigint, back bigint"


def write_index(log: DataFrame, folder: str, every: int = EVERY) -> DataFrame:
    """A sparse index of a recorded log: per segment of its order of arrival the least and largest slot and how far its rollbacks
    go back. Called again, it adds what has come since; parts of one segment add up when they are read."""
    spark = log.sparkSession
    index = read_index(spark, folder)
    last = index.agg(F.max("segment")).first()[0]
    rows = log if last is None else log.where(F.col("seq") >= last * every)
    slot = F.col("block.slot_no")
    back = F.min(F.when(F.col("op") == "ROLLBACK", F.coalesce("to_slot", F.lit(-1)))).alias("back")
    found = rows.groupBy(F.floor(F.col("seq") / every).alias("segment")).agg(F.min(slot).alias("low"), F.max(slot).alias("high"), back)
    found.repartitionByRange(1, "segment").write.mode("append").parquet(folder)  # a row a segment
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.schema(_INDEX).parquet(folder) if files.exists(spark, folder) else spark.createDataFrame([], _INDEX)
    return parts.groupBy("segment").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("back").alias("back"))


def newest_common(log: DataFrame, index: DataFrame, points: list[tuple[int | None, str | None]], every: int = EVERY, at_once: int = 16) -> tuple[int | None, str | None]:
    """The newest of the points (slot, hash) that the log's canonical chain has; genesis, (None, None), always is there.

    Points are tried newest first, some at once. The index tells which segments can hold one that no later segment takes
    back; only those are read and judged, not the log."""
    spark = log.sparkSession
    later = suffix_min(index, "segment", F.col("back"), "later").persist()
    try:
        known = sorted({p for p in points if p[0] is not None}, key=lambda p: (-p[0], p[1] or ""))
        for i in range(0, len(known), at_once):
            asked = spark.createDataFrame(known[i : i + at_once], "slot bigint, hash string")
            there = (F.col("slot") >= F.col("low")) & (F.col("slot") <= F.col("high")) & (F.col("later").isNull() | (F.col("later") >= F.col("slot")))
            segments = sorted(r[0] for r in later.join(F.broadcast(asked), there).select("segment").distinct().collect())
            found = _in_segments(log, segments, every).join(F.broadcast(asked), (F.col("slot_no") == F.col("slot")) & (F.col("hash").isNull() | (F.col("block_hash") == F.col("hash"))))
            found = found.join(F.broadcast(later.where(F.col("segment").isin(segments)).select("segment", "later")), "segment").where(F.col("later").isNull() | (F.col("later") >= F.col("slot_no")))
            newest = found.agg(F.max(F.struct("slot_no", "block_hash")).alias("p")).first()["p"]
            if newest is not None:
                return newest.slot_no, newest.block_hash
    finally:
        later.unpersist()
    if any(p[0] is None for p in points):
        return None, None
    raise NoIntersection(f"the source has none of {len(points)} points")


def _in_segments(log: DataFrame, segments: list[int], every: int) -> DataFrame:
    """The blocks of some segments that no rollback of their own segment takes back."""
    seq = F.col("seq")
    read = log.where(reduce(Column.__or__, [(seq >= s * every) & (seq < (s + 1) * every) for s in segments], F.lit(False)))
    rows = read.select("seq", "op", "to_slot", F.col("block.slot_no").alias("slot_no"), F.col("block.block_hash").alias("block_hash"), F.floor(seq / every).alias("segment"))
    after = Window.partitionBy("segment").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    back = F.min(F.when(F.col("op") == "ROLLBACK", F.coalesce("to_slot", F.lit(-1)))).over(after)
    return rows.withColumn("_back", back).where((F.col("op") == "INDEX") & (F.col("_back").isNull() | (F.col("_back") >= F.col("slot_no")))).drop("_back")


def with_epoch_and_time(rows: DataFrame, eras: DataFrame) -> DataFrame:
    """Adds epoch_no and block_time by the era that holds the slot.

    An era is (first_slot, first_epoch, first_time, epoch_slots, slot_seconds); a chain has a handful, and they are counted
    before they are broadcast.
    """
    many = eras.limit(10_001).count()
    if many > 10_000:
        raise InvalidTable("over 10,000 eras: not an era table")
    listed = eras.agg(F.sort_array(F.collect_list(F.struct("first_slot", "first_epoch", "first_time", "epoch_slots", "slot_seconds"))).alias("_eras"))
    era = F.element_at(F.filter("_eras", lambda e: e["first_slot"] <= F.col("slot_no")), -1)
    out = rows.crossJoin(F.broadcast(listed)).withColumn("_era", era).drop("_eras")  # one row on the right
    since: Column = F.col("slot_no") - F.col("_era.first_slot")
    return out.withColumns(
        {
            "epoch_no": F.col("_era.first_epoch") + F.floor(since / F.col("_era.epoch_slots")),
            "block_time": F.col("_era.first_time") + since * F.col("_era.slot_seconds"),
        }
    ).drop("_era")


#: Event files are named <prefix>_<just|nothing>_<block>_<slot>_<hash>.<suffix>.
NAME = r"([A-Za-z]+)_(just|nothing)_(\d+)_(\d+)_([0-9a-f]*)\.[A-Za-z0-9]+$"


def event_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """The event files of a folder in block order, with their content, null if there was nothing; a name that cannot be read is an error."""
    files = spark.read.format("binaryFile").load(folder).where(F.regexp_extract("path", r"([^/]*)$", 1).startswith(prefix + "_"))
    part = lambda n: F.regexp_extract("path", NAME, n)
    bad = F.raise_error(F.concat(F.lit("bad event file name: "), "path")).cast("bigint")
    block = F.when(part(1) != "", part(3).cast("bigint")).otherwise(bad)
    rows = files.select(block.alias("block_no"), part(4).try_cast("bigint").alias("slot_no"), part(5).alias("block_hash"), (part(2) == "just").alias("has_event"), F.when(part(2) == "just", F.col("content")).alias("content"), "path")
    return rows.orderBy("block_no")


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it, for tasks that write or read single files; a plain path is local."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


@dataclasses.dataclass
class Lines(InputPartition):
    """The lines of one file from `low` up to `high`."""

    path: str
    low: int
    high: int


class ChainReader(DataSourceStreamReader):
    """JSON lines in numbered files. The offset has, per file, the lines that were taken, so files may grow and come; tasks
    read `window` lines of a file each, and the driver counts lines only."""

    def __init__(self, folder: str, start: int, window: int):
        self.folder, self.start, self.window = folder, start, window

    def latestOffset(self) -> dict:
        """Whole lines of each file, in the order of names."""
        system, folder = at(self.folder)
        out = {}
        for info in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if info.path.endswith(".jsonl"):
                with system.open_input_stream(info.path) as file:
                    out[info.base_name] = sum(part.count(b"\n") for part in iter(lambda: file.read(1 << 20), b""))
        return out

    def initialOffset(self) -> dict:
        out, left = {}, self.start
        for name, lines in self.latestOffset().items():
            out[name] = min(lines, left)
            left -= out[name]
        if left:
            raise NoIntersection(f"the source has fewer than {self.start} lines")
        return out

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [Lines(f"{self.folder.rstrip('/')}/{name}", low, min(low + self.window, high)) for name, high in end.items() for low in range(start.get(name, 0), high, self.window)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        system, path = at(partition.path)
        with system.open_input_stream(path) as raw, io.TextIOWrapper(raw, encoding="utf-8") as file:
            for line in itertools.islice(file, partition.low, partition.high):
                x = json.loads(line)
                yield x["seq"], x["op"], x.get("slot_no"), x.get("block_no"), x.get("to_slot")

    def commit(self, end: dict) -> None:
        pass


class ChainSource(DataSource):
    """spark.dataSource.register(ChainSource); spark.readStream.format("chain").option("startingLine", n).load(folder), with
    option("window", n) for the lines of a task."""

    @classmethod
    def name(cls) -> str:
        return "chain"

    def schema(self) -> str:
        return "seq bigint, op string, slot_no bigint, block_no bigint, to_slot bigint"

    def streamReader(self, schema) -> ChainReader:
        return ChainReader(self.options["path"], int(self.options.get("startingLine", "0")), int(self.options.get("window", "100000")))


def away(error: Exception) -> bool:
    """Whether a source could not be reached; a failed stream wraps what happened."""
    return isinstance(error, ConnectionError) or (isinstance(error, StreamingQueryException) and any(x in str(error) for x in ("ConnectionError", "ConnectionRefused", "ConnectionReset", "java.net.")))


def retried(action: Callable[[], T_], first_wait: float = 1.0, longest: float = 1800.0, sleep: Callable[[float], None] = time.sleep, when: Callable[[Exception], bool] = away) -> T_:
    """Tries again with doubled waits, while the source is away, until they add up to `longest` seconds."""
    wait, waited = first_wait, 0.0
    while True:
        try:
            return action()
        except Exception as e:
            if waited >= longest or not when(e):
                raise
            pause = min(wait, longest - waited)
            sleep(pause)
            waited, wait = waited + pause, wait * 2
