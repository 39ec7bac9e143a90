"""Suffix-array dedup: remove every byte inside a string of `size` bytes that also starts anywhere else.

How repeats meet in one task: of each window of `size` bytes the least k-gram hash (the leftmost of equals) is its
anchor, so two equal windows have equal anchors at the same place. Consecutive windows with one anchor form a segment.

1. Chunks send (anchor, segment) hash pairs. The answer tells which segments occur in other chunks, too, which chunk is
   to send their bytes, and which anchors have several different segments. Segments whose anchor occurs once stop here.
2. Of each different segment of the other anchors one copy is sent, and two, from two places, if it occurs again. Each
   bucket builds enhanced suffix arrays of its segments (prefix doubling, ranks of every level kept for the LCP array)
   and stack-scans the common-prefix interval tree: intervals of at least `size` bytes whose left extensions differ are
   maximal repeat groups with all their occurrences. Nothing is removed but what they cover: the chunk of a segment that
   occurs once gets the covered spans, and all chunks with copies of a segment (equal by 128 bits) ask whether the two
   that were sent are covered.
3. Anchors with more than `hot` different segments would fill one task; the windows of their segments are counted by
   two hashes of 64 bits each instead, folded per chunk: among n such windows n^2 / 2^129 pairs are taken for equal that
   are not, less than 1e-15 for the 1e11 windows of 100 GB.

`repeat_groups` returns the groups themselves: a row per occurrence of each maximal repeat.

Texts are bytes in UTF-8; matches never cross documents; strings are judged on the input. Defined results: null and
empty texts have no bytes and no spans; rows that repeat a doc_id (or have none) count as documents of their own; an
empty table gives an empty table; other columns are ignored. A text is never cut: the task that holds it works on
blocks of windows, and its segments are dealt like those of other texts.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, textbytes

SIZE = 400
#: Different segments of one anchor that one suffix array may hold.
HOT = 2000
#: Bytes of segments in one suffix array; more only if one anchor has more.
ARRAY_BYTES = 1 << 18
_BLOCK = 1 << 18
_LETTER = textbytes.mix(np.arange(1, 257, dtype=np.uint64))
_OTHER = textbytes.mix(np.arange(1001, 1257, dtype=np.uint64))
SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


@dataclasses.dataclass
class Segments:
    """Runs of windows with one anchor: byte at which the run starts, its windows, and hashes of anchor and segment."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    body: np.ndarray


def segments(data: np.ndarray, offsets: np.ndarray, size: int) -> Segments:
    n = int(offsets[-1])
    gram = max(1, size // 3)
    width = size - gram + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    valid = ends - np.arange(n) >= size
    out: list[tuple[np.ndarray, ...]] = []
    lo, hi = textbytes.runs(valid)
    for a, b in zip(lo, hi):  # the windows of one document, in blocks
        for s in range(int(a), int(b), _BLOCK):
            out.append(_block(data, s, min(s + _BLOCK, int(b)), size, gram, width))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return Segments(empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    return Segments(*(np.concatenate(x) for x in zip(*out)))


def _block(data: np.ndarray, s: int, e: int, size: int, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """Segments of the windows that start in [s, e)."""
    body = data[s : e - 1 + size]
    up, down = textbytes._powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[body] * up[: len(body)], out=sums[1:])
    grams = textbytes.mix((sums[gram:] - sums[:-gram]) * down[: len(body) - gram + 1])
    packed = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(packed) // width)
    square = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    square[: len(packed)] = packed
    square = square.reshape(rows, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = e - s
    at = (np.minimum(back[:count], ahead[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    many = np.diff(np.concatenate((first, [count])))
    anchor = at[first]
    stop = first + many - 1 + size
    whole = (sums[stop] - sums[first]) * down[first]
    # least hashes are small: mixed once more they spread evenly over the buckets
    return first + s, many, textbytes.mix(grams[anchor]), textbytes.mix(whole ^ textbytes.mix((many << 32 | anchor - first).astype(np.uint64)))


# --- the enhanced suffix array -------------------------------------------------------------------------------------


class SuffixArray:
    """Enhanced suffix array of several byte strings; suffixes end with their string.

    Only suffixes of at least `least` bytes are wanted, the first ones of each string. To sort them by twice `size` bytes,
    and for their LCPs, the ranks of `size` bytes are needed at the wanted places and whole multiples of `size` behind."""

    def __init__(self, strings: list[bytes], least: int = 1):
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.text = np.frombuffer(b"".join(strings) + bytes(8), dtype=np.uint8)
        n = int(sizes.sum())
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        self.left = np.repeat(self.starts + sizes, sizes).astype(np.int32) - np.arange(n, dtype=np.int32)  # bytes to the string's end
        lanes = np.ndarray(shape=(n,), dtype=">u8", buffer=self.text, strides=(1,)).astype(np.uint64)
        short = np.minimum(self.left, 8)
        lanes &= ~textbytes._LOW[8 - short]
        order = np.argsort(lanes).astype(np.int32)
        sorted_lanes, sorted_short = lanes[order], short[order]
        if (mixed := np.flatnonzero((sorted_lanes[1:] == sorted_lanes[:-1]) & (sorted_short[1:] < sorted_short[:-1]))).size:
            order = np.lexsort((short, lanes)).astype(np.int32)  # zero bytes next to ends of strings
            sorted_lanes, sorted_short = lanes[order], short[order]
        del lanes, mixed
        new = np.ones(n, dtype=bool)
        new[1:] = (sorted_lanes[1:] != sorted_lanes[:-1]) | (sorted_short[1:] != sorted_short[:-1])
        self.order = order
        rank = np.empty(n, dtype=np.int32)  # of each suffix: the place at which its group of equals begins
        rank[order] = _group_starts(new, np.arange(n, dtype=np.int32))
        self.levels: list[tuple[int, np.ndarray]] = [(8, rank)]
        places = _in_groups(new)
        size, longest = 8, int(sizes.max(initial=0))
        wanted = np.repeat(np.maximum(sizes - least + 1, 0).astype(np.int32), sizes)
        offset = np.arange(n, dtype=np.int32) - np.repeat(self.starts.astype(np.int32), sizes)
        while size < longest and len(places):
            # equal suffixes shorter than `size` are equal to their ends and stay in place
            sub = order[places]
            places = places[(self.left[sub] >= size) & ((offset[sub] & (2 * size - 1)) < wanted[sub])]
            if not len(places):
                break
            rank = rank.copy()
            places = self._double(rank, places, size)
            size *= 2
            self.levels.append((size, rank))

    def _double(self, rank: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
        """Sorts the groups of suffixes that were equal in `size` bytes by the next `size`; `rank` and the order change in
        place. Returns the places of those still equal."""
        sub = self.order[places]
        follows = np.where(self.left[sub] > size, self.levels[-1][1][np.minimum(sub + size, len(rank) - 1)] + 1, 0)
        bits = len(rank).bit_length()
        key = rank[sub].astype(np.int64) << bits | follows
        if 3 * bits < 64:  # numbers that carry their place sort faster than places by numbers
            key = key << bits | np.arange(len(key))
            key.sort()
            by, key = key & ((1 << bits) - 1), key >> bits
        else:
            by = np.argsort(key)
            key = key[by]
        sub = sub[by]
        self.order[places] = sub
        new = np.ones(len(sub), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[sub] = _group_starts(new, places)
        return places[_in_groups(new)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, by the ranks of ever shorter prefixes."""
        n, out = len(self.order), np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for size, rank in reversed(self.levels):
            for _ in range(2 if size == self.levels[-1][0] else 1):
                fits = out + size <= most
                same = fits & (rank[np.minimum(a + out, n - 1)] == rank[np.minimum(b + out, n - 1)])
                out += size * same
        for _ in range(7):
            same = (out < most) & (self.text[a + out] == self.text[b + out])
            out += same
        return out

    def repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, positions) of every maximal repeat of at least `least` bytes: a common-prefix interval of the suffix
        array whose suffixes are not all preceded by the same byte. Positions are places in the joined strings."""
        # shorter suffixes cannot take part; leaving them out changes no interval of at least `least` bytes
        order = self.order[self.left[self.order] >= least]
        if len(order) < 2:
            return
        lcp = self.common(order[:-1], order[1:])
        before = np.where(order == self.starts[self.string[order]], -1 - order, self.text[order - 1].astype(np.int64))
        change = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
        lo, hi = textbytes.runs(lcp >= least)
        diverse = change[hi] > change[lo]  # no interval of a run is, if the run itself is not
        for a, b in zip(lo[diverse].tolist(), hi[diverse].tolist()):
            stack: list[tuple[int, int]] = []  # (length, leftmost suffix)
            for i, h in enumerate([*lcp[a:b].tolist(), 0], a):
                at = i
                while stack and stack[-1][0] > h:
                    length, at = stack.pop()
                    if change[i] > change[at]:
                        yield length, order[at : i + 1]
                if h and (not stack or stack[-1][0] < h):
                    stack.append((h, at))


def _group_starts(new: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each member of sorted groups the place at which its group begins."""
    first = np.flatnonzero(new)
    return np.repeat(places[first], np.diff(np.append(first, len(new))))


def _in_groups(new: np.ndarray) -> np.ndarray:
    """The members of groups of two and more."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone).astype(np.int32)


def covered_bytes(array: SuffixArray, least: int) -> np.ndarray:
    """Flags of the bytes of the joined strings that lie in a maximal repeat."""
    n = len(array.order)
    reach = np.zeros(n, dtype=np.int64)
    for length, positions in array.repeats(least):
        reach[positions] = np.maximum(reach[positions], length)
    at = np.flatnonzero(reach)
    return textbytes.covered(n, at, reach[at])


# --- the Spark job -------------------------------------------------------------------------------------------------

#: Kinds: 0 codes of pairs, 1 segments or their covered spans, 2 hot windows, 3 pairs that occur again.
_SPOKEN = "kind int, bucket int, chunk int, anchor long, body long, again boolean, data binary"
_REPLY = "kind int, bucket int, chunk int, anchor long, body long, data binary"
_PAIR = np.dtype([("anchor", "<u8"), ("body", "<u8")])
_ELSEWHERE, _SEVERAL, _LEADS, _HOT, _SECOND = 1, 2, 4, 8, 16


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in ascending order, which one each is, and their counts."""
    both = np.empty(len(first), dtype=_PAIR)
    both["anchor"], both["body"] = first, second
    order = np.lexsort((both["body"], both["anchor"]))
    both = both[order]
    new = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.zeros(0, bool)
    which = np.empty(len(both), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return both[new], which, np.bincount(which, minlength=int(new.sum()))


def _pair_blobs(pairs: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """As chunks.blobs, of ascending pairs."""
    edges = chunks.cuts(pairs["anchor"], buckets)
    some = np.flatnonzero(edges[1:] > edges[:-1])
    return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array(np.full(len(some), chunk), pa.int32()), "data": pa.array([pairs[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary())})


def _counted_pairs(table: pa.Table) -> pa.Table:
    """Per blob a byte for each of its pairs: 1 if another chunk sent it, too."""
    parts = [np.frombuffer(x.as_buffer(), dtype=_PAIR) for x in table.column("data")]
    every = np.concatenate(parts)
    _, which, times = _distinct(every["anchor"], every["body"])
    code = (times > 1).astype(np.uint8)[which]
    cuts = np.cumsum([0, *(len(p) for p in parts)])
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "data": pa.array([code[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _judge(hot: int):
    """Codes for the pairs of each blob."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), dtype=_PAIR) for x in table.column("data")]
        every = np.concatenate(parts)
        source = np.repeat(table.column("chunk").to_numpy(), [len(p) for p in parts])
        order = np.lexsort((source, every["body"], every["anchor"]))
        anchor, body = every["anchor"][order], every["body"][order]
        new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new = new_anchor | np.concatenate(([True], body[1:] != body[:-1]))
        pair, group = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        many = np.bincount(pair) > 1
        different = np.bincount(group, weights=new)
        second = np.concatenate(([False], new[:-1] & ~new[1:]))
        code = _ELSEWHERE * many[pair] + _SEVERAL * (different[group] > 1) + _LEADS * new + _HOT * (different[group] > hot) + _SECOND * second
        back = np.empty(len(order), dtype=np.uint8)
        back[order] = code
        cuts = np.cumsum([0, *(len(p) for p in parts)])
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "data": pa.array([back[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    return run


def _read(table: pa.Table, size: int):
    data, offsets = textbytes.flatten(table.column("text"))
    found = segments(data, offsets, size)
    return data, offsets, found, *_distinct(found.anchor, found.body)


def _windows(data: np.ndarray, start: int, windows: int, size: int, letters: np.ndarray) -> np.ndarray:
    """Hashes of the windows of one segment."""
    return textbytes.rolling(letters[data[start : start + windows - 1 + size]], size)


def _again(codes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Which pairs of a chunk occur more than once and are not hot."""
    return ((codes & _ELSEWHERE > 0) | (times > 1)) & (codes & _HOT == 0)


def _speak(texts: pa.Table, answers: pa.Table, size: int, buckets: int) -> pa.Table:
    """What a chunk sends on: bytes of segments that it is to send, hot windows, and the pairs whose verdict it needs."""
    data, _, found, pairs, which, times = _read(texts, size)
    codes = chunks.gather(answers)
    again = _again(codes, times)
    mine = codes & (_LEADS | _SECOND) > 0
    take = np.flatnonzero((again | (codes & _SEVERAL > 0)) & (codes & _HOT == 0) & mine)
    twice = take[(times[take] > 1) & (codes[take] & _ELSEWHERE == 0)]
    places = np.argsort(which, kind="stable")  # of each pair's segments, one pair after the other
    first = np.cumsum(times) - times
    at = np.concatenate((places[first[take]], places[first[twice] + 1]))
    take = np.concatenate((take, twice))
    bodies = [data[a : a + w - 1 + size].tobytes() for a, w in zip(found.start[at], found.windows[at])]
    chunk = texts.column("chunk")[0].as_py() if texts.num_rows else 0
    hot = _pair_blobs(_distinct(*_hot_windows(data, found, codes[which], size)[:2])[0], chunk, buckets)
    asked = _pair_blobs(pairs[again], chunk, buckets)
    n, m, k = len(take), hot.num_rows, asked.num_rows
    none = np.zeros(m + k, np.int64)
    own = chunks.bucket_of(pairs["anchor"][take], buckets).astype(np.int32)
    return pa.table(
        {
            "kind": pa.array(np.repeat([1, 2, 3], [n, m, k]), pa.int32()),
            "bucket": pa.array(np.concatenate((own, hot.column("bucket").to_numpy(), asked.column("bucket").to_numpy())), pa.int32()),
            "chunk": pa.array(np.full(n + m + k, chunk), pa.int32()),
            "anchor": pa.array(np.concatenate((pairs["anchor"][take].view(np.int64), none))),
            "body": pa.array(np.concatenate((pairs["body"][take].view(np.int64), none))),
            "again": pa.array(np.concatenate((again[take], none > 0))),
            "data": pa.array([*bodies, *hot.column("data").to_pylist(), *asked.column("data").to_pylist()], pa.binary()),
        }
    )


def _arrays(table: pa.Table, size: int) -> Iterator[tuple[pa.Table, SuffixArray]]:
    """The segments of a bucket, in suffix arrays of about ARRAY_BYTES that hold whole anchors."""
    table = table.sort_by("anchor")
    anchor = table.column("anchor").to_numpy()
    ends = np.cumsum([len(x.as_buffer()) for x in table.column("data")])
    cuts = np.flatnonzero(np.concatenate((anchor[1:] != anchor[:-1], [True]))) + 1  # after the last segment of an anchor
    start, done = 0, 0
    for cut, following in zip(cuts, [*cuts[1:], None]):
        if following is None or ends[following - 1] - done > ARRAY_BYTES:
            part = table.slice(start, cut - start)
            yield part, SuffixArray([x.as_py() for x in part.column("data")], size)
            start, done = int(cut), int(ends[cut - 1])


def _scan(table: pa.Table, size: int) -> pa.Table:
    """The verdicts of a bucket: covered spans of segments that occur once, a byte for each pair that was asked for (1: the
    copies that were sent are covered), and counts of hot windows."""
    kinds = table.column("kind").to_numpy()
    hot, asked = table.filter(pa.array(kinds == 2)), table.filter(pa.array(kinds == 3))
    told = []
    if hot.num_rows:
        counted = _counted_pairs(hot)
        told.append(_reply(2, counted.column("bucket"), counted.column("chunk"), None, None, counted.column("data").to_pylist()))
    bare: list[np.ndarray] = [np.zeros(0, _PAIR)]  # pairs of which a copy that was sent is not covered
    held: list[np.ndarray] = [np.zeros(0, _PAIR)]
    for part, array in _arrays(table.filter(pa.array(kinds == 1)), size) if (kinds == 1).any() else ():
        gone = covered_bytes(array, size)
        ends = np.append(array.starts[1:], len(gone))
        whole = np.add.reduceat(gone, array.starts, dtype=np.int64) == ends - array.starts
        again = part.column("again").to_numpy()
        pairs = np.empty(len(again), dtype=_PAIR)
        for name in ("anchor", "body"):
            pairs[name] = part.column(name).to_numpy().view(np.uint64)
        held.append(pairs[again & whole])
        bare.append(pairs[again & ~whole])
        rows, data = [], []
        for i in np.flatnonzero(~again):
            lo, hi = textbytes.runs(gone[array.starts[i] : ends[i]])
            if len(lo):
                rows.append(i)
                data.append(np.stack((lo, hi), axis=1).astype("<i4").tobytes())
        picked = part.take(pa.array(rows, pa.int64()))
        told.append(_reply(1, picked.column("bucket"), picked.column("chunk"), picked.column("anchor"), picked.column("body"), data))
    if asked.num_rows:
        sure = np.setdiff1d(np.concatenate(held), np.concatenate(bare))
        blobs = [np.isin(np.frombuffer(x.as_buffer(), dtype=_PAIR), sure).astype(np.uint8).tobytes() for x in asked.column("data")]
        told.append(_reply(3, asked.column("bucket"), asked.column("chunk"), None, None, blobs))
    return pa.concat_tables(told)


def _found(array: SuffixArray, part: pa.Table, size: int) -> Iterator[tuple]:
    """(anchor, body, repeat, length, at) of the maximal repeats of one array, once for equal segments."""
    anchor, body = part.column("anchor").to_pylist(), part.column("body").to_pylist()
    for length, positions in array.repeats(size):
        start = int(positions[0])
        name = hashlib.md5(array.text[start : start + length].tobytes()).hexdigest()
        own = array.string[positions]
        yield from {(anchor[s], body[s], name, length, p) for s, p in zip(own.tolist(), (positions - array.starts[own]).tolist())}


@dataclasses.dataclass
class _Steps:
    """The frames that the dedup and the groups share."""

    how: chunks.Deal
    placed: DataFrame
    judged: DataFrame
    spoken: DataFrame

    def with_texts(self, frame: DataFrame, run, schema: str) -> DataFrame:
        return self.placed.groupBy("chunk").cogroup(frame.groupBy("chunk")).applyInArrow(chunks.tidy(run), schema)

    def by_bucket(self, run, schema: str) -> DataFrame:
        return self.spoken.repartition(self.how.parts, "bucket").groupBy("bucket").applyInArrow(chunks.tidy(run), schema)


def _steps(docs: DataFrame, size: int, how: chunks.Deal | None, hot: int) -> _Steps:
    how = how or chunks.deal(docs)
    buckets = how.buckets
    placed = chunks.dealt(docs, how, "doc_id", "text")
    sent = placed.groupBy("chunk").applyInArrow(chunks.tidy(lambda key, table: _pair_blobs(_read(table, size)[3], key[0].as_py(), buckets)), chunks.BLOBS)
    judged = sent.repartition(how.parts, "bucket").groupBy("bucket").applyInArrow(chunks.tidy(_judge(hot)), chunks.BLOBS)
    steps = _Steps(how, placed, judged, judged)
    steps.spoken = steps.with_texts(judged, lambda texts, answers: _speak(texts, answers, size, buckets), _SPOKEN)
    return steps


def suffix_dedup(docs: DataFrame, size: int = SIZE, how: chunks.Deal | None = None, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, the maximal removed spans (in bytes) and the remaining bytes."""
    steps = _steps(docs, size, how, hot)

    def remove(texts: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets, found, pairs, which, times = _read(texts, size)
        kinds = replies.column("kind").to_numpy()
        codes, twice, sure = (chunks.gather(replies.filter(pa.array(kinds == k))) for k in (0, 2, 3))
        full = np.zeros(len(pairs), dtype=bool)
        full[_again(codes, times)] = sure > 0
        full = full[which]
        starts, lengths = [found.start[full]], [found.windows[full] - 1 + size]
        told = replies.filter(pa.array(kinds == 1))
        if told.num_rows:
            first = dict(zip(zip(pairs["anchor"].view(np.int64).tolist(), pairs["body"].view(np.int64).tolist()), range(len(pairs))))
            one = np.empty(len(pairs), dtype=np.int64)
            one[which] = np.arange(len(which))
            for a, b, blob in zip(told.column("anchor").to_pylist(), told.column("body").to_pylist(), told.column("data")):
                part = np.frombuffer(blob.as_buffer(), dtype="<i4").reshape(-1, 2).astype(np.int64)
                starts.append(part[:, 0] + found.start[one[first[a, b]]])
                lengths.append(part[:, 1] - part[:, 0])
        if (codes & _HOT).any():
            *hashes, at = _hot_windows(data, found, codes[which], size)
            _, group, many = _distinct(*hashes)
            repeated = ((many > 1) | (twice > 0))[group]
            starts.append(at[repeated])
            lengths.append(np.full(int(repeated.sum()), size))
        gone = textbytes.covered(int(offsets[-1]), np.concatenate(starts), np.concatenate(lengths))
        rows = {k: [] for k in ("n_removed", "spans", "kept")}
        for a, b in zip(offsets[:-1], offsets[1:]):
            flags = gone[a:b]
            lo, hi = textbytes.runs(flags)
            rows["n_removed"].append(int(flags.sum()))
            rows["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
            rows["kept"].append(data[a:b][~flags].tobytes() if len(lo) else data[a:b].tobytes())
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": np.diff(offsets), **rows}, schema=_ARROW)

    scanned = steps.by_bucket(lambda table: _scan(table, size), _REPLY)
    none = F.lit(0).cast("long")
    replies = steps.judged.select(F.lit(0).alias("kind"), "bucket", "chunk", none.alias("anchor"), none.alias("body"), "data").union(scanned)
    return steps.with_texts(replies, remove, SCHEMA)


def repeat_groups(docs: DataFrame, size: int = SIZE, how: chunks.Deal | None = None, hot: int = HOT) -> DataFrame:
    """A row per occurrence of each maximal repeat: repeat (its MD5 in hexadecimal digits; of hot windows, both hashes),
    length, doc_id and start, in bytes. Repeats are maximal within segments, so one that is longer than a segment comes as
    several that overlap, and each window of `size` bytes that starts in two places lies in one of them. Hot windows are
    groups of `size` bytes each. Copies of a text are occurrences of their own, also where they have one doc_id."""
    steps = _steps(docs, size, how, hot)

    def places(texts: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets, found, pairs, which, times = _read(texts, size)
        codes = chunks.gather(answers)
        told = np.flatnonzero((_again(codes, times) | (codes & _SEVERAL > 0) & (codes & _HOT == 0))[which])
        first, second, at = _hot_windows(data, found, codes[which], size)
        start = np.concatenate((found.start[told], at))
        row = np.searchsorted(offsets, start, side="right") - 1
        return pa.table(
            {
                "hot": pa.array(np.repeat([False, True], [len(told), len(at)])),
                "anchor": pa.array(np.concatenate((found.anchor[told], first)).view(np.int64)),
                "body": pa.array(np.concatenate((found.body[told], second)).view(np.int64)),
                "doc_id": texts.column("doc_id").take(pa.array(row, pa.int64())),
                "start": pa.array(start - offsets[row], pa.int64()),
            }
        )

    def scan(table: pa.Table) -> pa.Table:
        segments_ = table.filter(pa.array(table.column("kind").to_numpy() == 1))
        rows = [r for part, array in _arrays(segments_, size) for r in _found(array, part, size)] if segments_.num_rows else []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _FOUND.types)], schema=_FOUND)

    every = steps.with_texts(steps.judged, places, "hot boolean, anchor long, body long, doc_id long, start long")
    found = steps.by_bucket(scan, "anchor long, body long, repeat string, length long, at long")
    cold = every.where("not hot").join(found, ["anchor", "body"]).select("repeat", "length", "doc_id", (F.col("start") + F.col("at")).alias("start"))
    windows = every.where("hot")
    twice = windows.groupBy("anchor", "body").count().where("count > 1").select("anchor", "body")
    name = F.concat(F.lpad(F.lower(F.hex("anchor")), 16, "0"), F.lpad(F.lower(F.hex("body")), 16, "0"))
    return cold.union(windows.join(twice, ["anchor", "body"], "left_semi").select(name, F.lit(size).cast("long"), "doc_id", "start"))


_FOUND = pa.schema([("anchor", pa.int64()), ("body", pa.int64()), ("repeat", pa.string()), ("length", pa.int64()), ("at", pa.int64())])


def _hot_windows(data: np.ndarray, found: Segments, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the windows of hot segments, and where they start."""
    hot = np.flatnonzero(codes & _HOT)
    hashes = [[_windows(data, int(found.start[i]), int(found.windows[i]), size, letters) for i in hot] for letters in (_LETTER, _OTHER)]
    at = [found.start[i] + np.arange(found.windows[i]) for i in hot]
    return *(np.concatenate([np.zeros(0, np.uint64), *h]) for h in hashes), np.concatenate([np.zeros(0, np.int64), *at])


def _reply(kind: int, bucket, chunk, anchor, body, data: list[bytes]) -> pa.Table:
    none = pa.array(np.zeros(len(data), np.int64))
    return pa.table({"kind": pa.array(np.full(len(data), kind), pa.int32()), "bucket": bucket, "chunk": chunk, "anchor": none if anchor is None else anchor, "body": none if body is None else body, "data": pa.array(data, pa.binary())})


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Texts as hexadecimal digits, cut into pieces so that a window is found without reading the whole text again.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1822) AS h, least(512, n - o) AS m FROM (SELECT doc_id, h, len(h) // 2 - 399 AS n, unnest(range(0, len(h) // 2 - 399, 512)) AS o FROM d)),
w AS (SELECT doc_id, o + q AS p, md5(substr(h, 2 * q + 1, 800)) AS k FROM (SELECT doc_id, o, h, unnest(range(0, m)) AS q FROM b)),
g AS (SELECT doc_id, p, p - 400 > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -401) AS starts FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
i AS (SELECT doc_id, count(*) FILTER (starts) OVER (PARTITION BY doc_id ORDER BY p) AS i, p FROM g),
spans AS (SELECT doc_id, i, min(p) AS a, max(p) + 400 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM i GROUP BY doc_id, i),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id),
keep AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM (
         SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN spans > 0 THEN coalesce(k, '') ELSE h END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN keep USING (doc_id)
"""
