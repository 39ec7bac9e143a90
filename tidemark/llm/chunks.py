"""Dealing texts out in chunks, and counting 64-bit hashes across chunks.

Documents are dealt by a hash of doc_id and text into chunks of a bounded number of bytes, so that many rows without an
id, or with one id, are spread too. A chunk sends, per hash bucket, one blob with its distinct hashes in ascending order,
so a hash that a third of all texts share arrives once per chunk and not once per text. The bucket answers each blob with
one code per hash, by rank of the hash, so the answer does not depend on the order in which Spark delivers rows. Buckets
are dealt into as many parts as the texts, so what a task reads does not grow with the input.
"""

from __future__ import annotations

import ctypes
import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

BLOBS = "bucket int, chunk int, data binary"


@dataclasses.dataclass(frozen=True)
class Deal:
    """How many chunks and hash buckets; both follow the input's size."""

    chunks: int
    buckets: int
    parts: int


def deal(docs: DataFrame, text: str = "text", chunk_bytes: int = 3 << 20, bucket_bytes: int = 8 << 20) -> Deal:
    """One pass over the text column adds up its bytes. Chunks and buckets grow (up to 64 MB) once there would be over 16,384."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    size = min(max(chunk_bytes, total // 16384), 64 << 20)
    chunks = max(1, math.ceil(total / size))
    bucket = min(max(bucket_bytes, total // 16384), 64 << 20)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (64 << 20)))
    return Deal(chunks, max(1, math.ceil(total / bucket)), parts)


def chunk_of(how: Deal) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(how.chunks)).cast("int").alias("chunk")


def dealt(docs: DataFrame, how: Deal, *columns: str | Column) -> DataFrame:
    """The rows with their chunk; every later step on chunks reuses this one exchange of the texts."""
    return docs.select(*columns, chunk_of(how)).repartition(how.parts, "chunk")


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash, so that sorted hashes lie bucket by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending hashes; buckets + 1 values."""
    return np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))


def blobs(hashes: np.ndarray, chunk: int, buckets: int, kind: str = "<u8") -> pa.Table:
    """A row per bucket that has hashes; kind <u4 keeps the low half only."""
    edges = cuts(hashes, buckets)
    some = np.flatnonzero(edges[1:] > edges[:-1])
    narrow = hashes.astype(kind)
    return pa.table(
        {
            "bucket": pa.array(some, pa.int32()),
            "chunk": pa.array(np.full(len(some), chunk), pa.int32()),
            "data": pa.array([narrow[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary()),
        }
    )


def answer(sent: DataFrame, how: Deal, code: Callable[[np.ndarray], np.ndarray], kind: str = "<u8") -> DataFrame:
    """Per blob, a byte for each of its hashes: `code` of the number of chunks that sent the hash; 0 for one chunk."""

    return sent.repartition(how.parts, "bucket").groupBy("bucket").applyInArrow(tidy(lambda table: counted(table, code, kind)), BLOBS)


def counted(table: pa.Table, code: Callable[[np.ndarray], np.ndarray], kind: str = "<u8") -> pa.Table:
    """`answer` for the blobs of one bucket."""
    parts = [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column("data")]
    every = np.concatenate(parts)
    every.sort()
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))
    many = np.diff(at) > 1
    values, codes = every[at[:-1][many]], code(np.diff(at)[many]).astype(np.uint8)
    del every
    data = pa.array([_look(values, codes, p).tobytes() for p in parts], pa.binary())
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "data": data})


def _look(values: np.ndarray, codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(wanted), dtype=np.uint8)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, codes[at], 0).astype(np.uint8)


def gather(answers: pa.Table) -> np.ndarray:
    """The codes of one chunk in ascending order of its distinct hashes."""
    pairs = sorted(zip(answers.column("bucket").to_pylist(), answers.column("data")), key=lambda x: x[0])
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), dtype=np.uint8) for _, x in pairs)])


def slices(table: pa.Table, column: str = "text", most: int = 1 << 20) -> Iterator[pa.Table]:
    """The rows in pieces of about `most` bytes of text, so that arrays over a piece stay small; memory that the pieces
    leave free goes back to the system."""
    start, size = 0, 0
    for i, n in enumerate(_sizes(table.column(column))):
        if size and size + n > most:
            yield table.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < table.num_rows:
        yield table.slice(start)
    del table
    give_back()


def give_back() -> None:
    """Python workers live on between tasks: what they no longer use must not add up next to the next stage's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same function of a group, with give_back() after each."""

    def run(*tables):
        try:
            return f(*tables)
        finally:
            give_back()

    # Spark counts the arguments to tell whether a function takes the key
    return {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[f.__code__.co_argcount]


def _sizes(column: pa.ChunkedArray) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_pylist()
