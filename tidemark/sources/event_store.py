"""Event files, one per event, and block ranges, written for others to read.

Files go to a folder that all executors share, on any file system that has an address; a file is written under another name
first and then moved, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.changelog import valid_rows
from tidemark.operators.preprocess import in_block_range, just_before_range
from tidemark.sources.chain import at, event_files


def write_events(rows: DataFrame, folder: str, prefix: str, suffix: str = "bin") -> None:
    """A file <prefix>_<just|nothing>_<block>_<slot>_<hash>.<suffix> per row of (block_no, slot_no, block_hash, content); a row
    without content is 'nothing', a file of one line feed."""

    def run(part: Iterator) -> None:
        system, where = at(folder)
        system.create_dir(where, recursive=True)
        for r in part:
            name = f"{prefix}_{'nothing' if r.content is None else 'just'}_{r.block_no}_{r.slot_no}_{r.block_hash}.{suffix}"
            new = f"{where}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(new) as file:
                file.write(b"\n" if r.content is None else bytes(r.content))
            system.move(new, f"{where}/{name}")

    rows.select("block_no", "slot_no", "block_hash", "content").foreachPartition(run)


def _remove(files: DataFrame) -> None:
    def run(part: Iterator) -> None:
        for r in part:
            system, path = at(r.path)
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)

    files.foreachPartition(run)


def roll_back(events: DataFrame, slot: int | None) -> None:
    """Removes the files (of event_files) after a slot; None is genesis and removes all."""
    _remove(events if slot is None else events.where(F.col("slot_no") > slot))


def keep_newest(events: DataFrame, n: int, stable_slot: int) -> None:
    """Removes final files, those at or before the stable slot, but for the n newest of them."""
    final = events.where(F.col("slot_no") <= stable_slot)
    newest = final.orderBy(F.desc("slot_no")).limit(n).select("path")
    _remove(final.join(newest, "path", "left_anti"))


def resumed(spark, folder: str, prefix: str, stable_slot: int | None) -> DataFrame:
    """Opens a folder: what lies after the last stable slot may be on a fork that is gone and is removed."""
    if stable_slot is not None:
        roll_back(event_files(spark, folder, prefix), stable_slot)
    return event_files(spark, folder, prefix)


def write_range(log: DataFrame, low: int, high: int, folder: str) -> None:
    """The canonical blocks low..high of a recorded log to folder/blocks, and the one before them to folder/before."""
    head = F.coalesce("block.first_tx", F.lit(0)) == 0
    flat = log.where(head).select("seq", "op", "to_slot", F.col("block.slot_no").alias("slot_no"), F.col("block.block_no").alias("block_no"))
    flat = flat.persist()  # positions only, a row a block; their blocks, in however many rows, meet them afterwards
    try:
        valid = valid_rows(flat)
        for name, rows in (("blocks", in_block_range(valid, low, high)), ("before", just_before_range(valid, low))):
            log.where("op = 'INDEX'").join(_seqs(rows), "seq", "left_semi").select("block.*").sortWithinPartitions("slot_no", "first_tx").write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        flat.unpersist()


def _seqs(rows: DataFrame) -> DataFrame:
    """The numbers of some blocks, broadcast if they are 1,000,000 (8 MB) or fewer, so that the log is not shuffled for them."""
    seqs = rows.select("seq")
    return F.broadcast(seqs) if seqs.limit(1_000_001).count() <= 1_000_000 else seqs


def line_writer(folder: str):
    """For foreachPartition: the lines of a partition (p, line) as the file <p>.jsonl, whole or not at all."""

    def run(part: Iterator) -> None:
        system, where = at(folder)
        system.create_dir(where, recursive=True)
        first = next(part, None)
        if first is None:
            return
        new = f"{where}/.{first.p}.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as file:
            file.write(f"{first.line}\n".encode())
            for r in part:
                file.write(f"{r.line}\n".encode())
        system.move(new, f"{where}/{first.p:05d}.jsonl")

    return run
