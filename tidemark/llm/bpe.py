"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A bucket per merge rank holds linked-list positions whose pair has that rank. A two-level bitmap (256 ranks a word)
marks the buckets that hold something, so find-first-set gives the lowest rank in two steps whatever the length of
the pre-tokens. An entry is stale if its position is gone or its pair has another rank by now; it is skipped when met.

All different pre-tokens of a batch that are not known yet lie in one linked list with ends between them, and share the
queue: they do not touch, so each is merged as if alone, while a bucket is merged in one vectorised step. The order
inside a pre-token is kept: of overlapping pairs the left one goes first, and where a merge makes a pair of a lower
rank, the pre-token's other pairs of the bucket wait.

The vocabulary is a rank file (base64 token, rank per line); its path is a parameter, the driver reads it and its
content is broadcast. Ids are kept as little-endian unsigned 32-bit integers in a binary column.

Defined results: null and empty texts have no ids and decode to no bytes; rows are encoded one by one, so repeated rows
and ids give repeated results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chunks
from tidemark.llm.shared import others

#: Pre-tokens that a worker remembers; beyond it starts anew with the next batch.
REMEMBERED = 120_000
#: Bytes of text in a batch.
BATCH = 2 << 20


class RankQueue:
    """Positions by rank, in arrays."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Positions with the ranks of their pairs; negative ranks are no pairs."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        if not len(order):
            return
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
            bucket = self.buckets.get(r)
            if bucket is None:
                self.buckets[r] = [positions[a:b]]
                self.low[r >> 8] |= 1 << (r & 255)
                self.top |= 1 << (r >> 8)
            else:
                bucket.append(positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions in ascending order."""
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        least = self.low[word] & -self.low[word]
        self.low[word] ^= least
        if not self.low[word]:
            self.top ^= 1 << word
        rank = word << 8 | least.bit_length() - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


class Encoder:
    """Ids of many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.count = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}  # ids of two parts to the rank of both together
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a * self.count + b] = r
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 if they do not merge."""
        keys = a.astype(np.int64) * self.count + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.int32(-1))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and len + 1 offsets. A piece that is a token is that token, however it would merge."""
        known = [self.ranks.get(p, -1) for p in pieces]
        merged, ends = self._merge([p for p, r in zip(pieces, known) if r < 0])
        known_at = np.array(known, dtype=np.int64)
        sizes = np.ones(len(pieces), dtype=np.int64)
        sizes[known_at < 0] = np.diff(ends)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(offsets[-1], dtype=np.uint32)
        single = np.zeros(len(out), dtype=bool)
        single[offsets[:-1][known_at >= 0]] = True
        out[single] = known_at[known_at >= 0]
        out[~single] = merged
        return out, offsets

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        n = int(ends[-1])
        self.token = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        self.after = np.arange(1, n + 1, dtype=np.int32)
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        self.after[ends[1:] - 1] = -1
        self.before[ends[:-1]] = -1
        self.owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        self.rank = np.full(n, -1, dtype=np.int32)  # of the pair that begins at each position; -1 also where one is gone
        alive = np.ones(n, dtype=bool)
        queue, first = RankQueue(self.count), np.flatnonzero(self.after >= 0).astype(np.int32)
        self.rank[first] = self.pair(self.token[first], self.token[first + 1])
        queue.push(self.rank[first], first)
        while (entry := queue.pop()) is not None:
            r, at = entry
            at = at[self.rank[at] == r]  # the others are stale
            if len(at) > 1:
                at, wait = self._now(r, at)
                if len(wait):
                    queue.push(np.full(len(wait), r, dtype=np.int32), wait)
            if len(at):
                gone = self.after[at]
                next_ = self.after[gone]
                self.token[at] = r
                self.after[at] = next_
                self.rank[gone] = -1
                alive[gone] = False
                more = next_ >= 0
                self.before[next_[more]] = at[more]
                previous = self.before[at]
                left = previous[previous >= 0]
                right = at[more]
                self.rank[at] = -1
                self.rank[right] = self.pair(self.token[right], self.token[next_[more]])
                self.rank[left] = self.pair(self.token[left], self.token[self.after[left]])
                touched = np.concatenate((right, left))
                queue.push(self.rank[touched], touched)
        kept = np.flatnonzero(alive)
        return self.token[kept], np.searchsorted(kept, ends)

    def _now(self, r: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs of one rank merge now, and which wait."""
        gone = self.after[at]
        overlaps = gone[:-1] == at[1:]
        next_, previous = self.after[gone], self.before[at]
        lower = np.zeros(len(at), dtype=bool)
        r_ = np.full(len(at), r, dtype=np.int32)
        for there, here in ((next_, True), (previous, False)):
            some = there >= 0
            for token in (self.token[there[some]], r_[some]):  # the neighbour as it is, and as it may become
                made = self.pair(r_[some], token) if here else self.pair(token, r_[some])
                lower[some] |= (made >= 0) & (made < r)
        if not overlaps.any() and not lower.any():
            return at, at[:0]
        # of a run of overlapping pairs every other one merges, which leaves the pairs between them without their parts
        place = np.arange(len(at))
        begins = np.concatenate(([0], np.where(overlaps, 0, place[1:])))
        now = (place - np.maximum.accumulate(begins)) % 2 == 0
        if not lower.any():
            return at[now], at[:0]
        # in a pre-token all pairs up to the first that makes a lower one merge, the others wait
        owner = self.owner[at]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        earlier = np.concatenate(([0], np.cumsum(now & lower)[:-1]))
        wait = earlier > np.repeat(earlier[starts], np.diff(np.append(starts, len(at))))
        return at[now & ~wait], at[wait]


class Codec:
    """Encodes batches of texts; remembers the pre-tokens it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.find = regex.compile(pattern).findall
        self.encoder, self.remembered = Encoder(ranks), remembered
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.ids, self.offsets = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        if len(self.place) > self.remembered:
            self._forget()
        place, known = self.place, len(self.place)
        found = [np.fromiter(map(place.__getitem__, self.find(t)), dtype=np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        if len(place) > known:
            fresh = [p.encode() for p in place.newest(known)]
            ids, offsets = self.encoder.encode(fresh)
            self.offsets = np.concatenate((self.offsets, offsets[1:] + len(self.ids)))
            self.ids = np.concatenate((self.ids, ids))
        sizes = np.diff(self.offsets)
        out = []
        for pieces in found:
            many = sizes[pieces]
            ends = np.cumsum(many)
            at = np.repeat(self.offsets[pieces] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            out.append(self.ids[at].astype("<u4").tobytes())
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


class _Places(dict):
    """Numbers pre-tokens in the order in which they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        return place

    def newest(self, known: int) -> list[str]:
        """The pre-tokens from number `known` on; a dict keeps its order."""
        out = []
        for piece in reversed(self):
            if len(out) == len(self) - known:
                break
            out.append(piece)
        return out[::-1]


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec per worker and vocabulary; workers that Spark uses again keep its cache."""
    key = hash(shared.value), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(shared.value), pattern)
    return _CODECS[key]


def _share(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    shared = _share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for table in chunks.slices(pa.Table.from_batches([batch]), most=BATCH):
                ids = codec.encode(table.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The rows of `encode` with their decoded bytes."""
    shared = _share(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            decoded = pa.array([codec.decode(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def tokenized(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The rows with all their columns but the text, its ids, and whether they decode to the text's bytes."""
    shared = _share(docs.sparkSession, vocabulary)
    rows = docs.select("doc_id", "text", others(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for table in chunks.slices(pa.Table.from_batches([batch]), most=BATCH):
                texts = table.column("text").to_pylist()
                ids = codec.encode(texts)
                same = [codec.decode(x) == (t or "").encode() for x, t in zip(ids, texts)]
                columns = {"doc_id": table.column("doc_id"), "row": table.column("row"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "round_trip": pa.array(same, pa.bool_())}
                yield from pa.table(columns).to_batches()

    schema = T.StructType().add("doc_id", "long").add(rows.schema["row"]).add("n_tokens", "long").add("ids", "binary").add("round_trip", "boolean")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return rows.mapInArrow(run, schema).select("doc_id", *own, "n_tokens", "ids", "round_trip")


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern of the pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = default_vocabulary()
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, pattern), vocabulary, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
