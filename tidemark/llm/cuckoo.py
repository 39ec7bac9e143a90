"""A cuckoo filter over 128-bit keys: insertion, deletion and vectorised lookup."""

from __future__ import annotations

import numpy as np

from tidemark.llm.textbytes import mix

SLOTS = 4
_KICKS = 500


class Full(Exception):
    """No slot was found; build a larger filter from the exact table."""


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(keys, 1) / (0.8 * SLOTS) + 1))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def built(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        """A filter that holds all the keys; it doubles until they fit."""
        room = max(len(hi), 1)
        while True:
            try:
                out = cls.sized(room)
                out.insert(hi, lo)
                return out
            except Full:
                room *= 2

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.places(hi, lo, np.uint64(len(self.table) - 1))

    @staticmethod
    def places(hi: np.ndarray, lo: np.ndarray, last: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, in filters whose last buckets are `last`."""
        prints = ((lo.astype(np.uint64) >> np.uint64(48)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
        first = mix(hi.astype(np.uint64)) & last
        return prints, first, first ^ (mix(prints.astype(np.uint64)) & last)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True for every key inserted and not deleted since; seldom true for others."""
        prints, one, two = self._places(hi, lo)
        return (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        last = len(self.table) - 1
        turn = 0
        for f, a, b in zip(*(x.tolist() for x in self._places(hi, lo))):
            if self._put(a, f) or self._put(b, f):
                continue
            at = b
            for _ in range(_KICKS):
                turn = (turn + 1) % SLOTS
                f, self.table[at, turn] = int(self.table[at, turn]), f
                at ^= int(mix(np.array([f], dtype=np.uint64))[0]) & last
                if self._put(at, f):
                    break
            else:
                raise Full

    def _put(self, bucket: int, f: int) -> bool:
        for s in range(SLOTS):
            if not self.table[bucket, s]:
                self.table[bucket, s] = f
                return True
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for f, a, b in zip(*(x.tolist() for x in self._places(hi, lo))):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == f)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                raise KeyError("the key is not in the filter")


class FilterSet:
    """The filters of all shards, probed at once; a key's shard is its first half modulo their number."""

    def __init__(self, filters: list[CuckooFilter]):
        sizes = np.array([len(f.table) for f in filters], dtype=np.int64)
        self.table = np.concatenate([f.table for f in filters])
        self.start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.last = (sizes - 1).astype(np.uint64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = hi % len(self.last)
        prints, one, two = CuckooFilter.places(hi, lo, self.last[shard])
        start = self.start[shard]
        return (self.table[start + one.astype(np.int64)] == prints[:, None]).any(axis=1) | (self.table[start + two.astype(np.int64)] == prints[:, None]).any(axis=1)
