"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample, among the texts that passed the base test and every rule
placed before it, with the features that those have worked out already; the rule with most rejections per cost comes
next. Rules then run in that order, each only over the documents that every earlier rule let pass. The verdict is the
conjunction of all rules, so the order changes the work and not the result.

Words are [^\\x20\\x09-\\x0D]+. Defined results: null and empty texts have no words, fail the base test and are not
kept; texts of any length are judged whole; rows are judged one by one, so repeated rows and ids give repeated results;
labelled documents without a language take no part in the fit; an empty table gives an empty one; `judge` ignores other columns, whatever their names, and `keep` hands them on.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, textbytes, toxicity

SYMBOLS = b"#*$%&|<>"
#: Documents that the sample has on average.
SAMPLE = 512

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = np.ones(256, dtype=bool)  # first bytes of code points
_HEAD[0x80:0xC0] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True


class Texts:
    """A batch of texts with features that are worked out when first asked for."""

    #: What is known per text goes along with the texts that are taken.
    COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def take(self, rows: np.ndarray) -> Texts:
        out = Texts(self.column.take(pa.array(rows)))
        out.__dict__.update((c, self.__dict__[c][rows]) for c in self.COUNTS if c in self.__dict__)
        return out

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return textbytes.flatten(self.column)

    @property
    def data(self) -> np.ndarray:
        return self.flat[0]

    @property
    def offsets(self) -> np.ndarray:
        return self.flat[1]

    def count(self, flags: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        cuts = self.offsets if cuts is None else cuts
        return sums[cuts[1:]] - sums[cuts[:-1]]

    @cached_property
    def body(self) -> np.ndarray:
        return self.data[: self.offsets[-1]]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return textbytes.spans(self.data, self.offsets, textbytes.NOT_SPACE)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(textbytes.NOT_SPACE[self.body] & _HEAD[self.body])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL[self.body])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that are equal to an earlier one."""
        out = np.zeros((2, len(self)), dtype=np.int64)
        raw = self.body.tobytes()
        for i, (a, b) in enumerate(zip(self.offsets[:-1], self.offsets[1:])):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            out[:, i] = len(lines), len(lines) - len(set(lines))
        return out[0], out[1]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self.lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self.words
        windows = textbytes.rolling(textbytes.word_hashes(self.data, starts, ends), 5)
        ok = np.flatnonzero(textbytes.inside_text(first, 5))
        owner = np.searchsorted(first, ok, side="right").astype(np.uint64)
        _, which, times = np.unique(windows[ok] ^ textbytes.mix(owner), return_inverse=True, return_counts=True)
        return self.count(textbytes.covered(int(first[-1]), ok[times[which] > 1], 5), first)

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self.count(_LETTER[self.body])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.count(_UPPER[self.body])

    @cached_property
    def plain_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = textbytes.LOWER[self.data]
        return low, *textbytes.spans(low, self.offsets, textbytes.ALNUM)

    def n_begun_by(self, stems: dict[int, np.ndarray]) -> np.ndarray:
        """Words per text that begin with a stem; hashes of the stems by their size in bytes."""
        low, starts, ends, first = self.plain_words
        flags = np.zeros(len(starts), dtype=bool)
        for size, hashes in stems.items():
            long = np.flatnonzero(ends - starts >= size)
            flags[long] |= np.isin(textbytes.word_hashes(low, starts[long], starts[long] + size), hashes)
        return self.count(flags, first)


def _hashed(words: Sequence[str]) -> np.ndarray:
    data, offsets = textbytes.flatten(pa.array(words, pa.string()))
    return textbytes.word_hashes(data, offsets[:-1], offsets[1:])


@dataclasses.dataclass(frozen=True)
class Rule:
    """`rejects` gives a flag per text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < 10) | (100 * t.n_repeat_words > 20 * t.n_words)


#: The rules that need no labels.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
    Rule("capitals", lambda t: 10 * t.n_upper > 3 * t.n_letters),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 3 * t.n_lines),
)


def frequent_stems(found: dict[str, toxicity.Stems]) -> Rule:
    """By toxicity.frequent, as SQL states it."""
    sized = [({n: _hashed([s for s in m.stems if len(s.encode()) == n]) for n in {len(s.encode()) for s in m.stems}}, m.cut) for m in found.values()]

    def rejects(t: Texts) -> np.ndarray:
        out, n = np.zeros(len(t), dtype=bool), np.diff(t.plain_words[3])
        for stems, cut in sized:
            out |= toxicity.ONE * t.n_begun_by(stems) > cut * n
        return out

    return Rule("frequent_stems", rejects)


def rules_for(docs: DataFrame, labels: DataFrame) -> tuple[Rule, ...]:
    """RULES, and the stems that are frequent in the labelled toxic documents (which need a `lang`)."""
    return (*RULES, frequent_stems(toxicity.frequent(docs, labels)))


def estimate(texts: Texts, rules: Sequence[Rule]) -> list[tuple[Rule, float, np.ndarray]]:
    """(rule, seconds, flags of the texts it rejects), each rule with no more features than `texts` has."""
    out = []
    for rule in rules:
        own, began = texts.take(np.arange(len(texts))), time.perf_counter()
        flags = rule.rejects(own)
        out.append((rule, max(time.perf_counter() - began, 1e-9), flags))
    return out


def best(estimates: Sequence[tuple[Rule, float, np.ndarray]]) -> tuple[Rule, float, np.ndarray]:
    """The most rejections per cost; of equals the cheapest."""
    return min(estimates, key=lambda x: (-int(x[2].sum()) / x[1], x[1], x[0].name))


def ordered(sample: pa.ChunkedArray | pa.Array, rules: Sequence[Rule]) -> list[Rule]:
    """The rules in the order in which they are to run; what the sample leaves at the end goes by cost alone."""
    texts = Texts(sample)
    texts = texts.take(np.flatnonzero(~base_failed(texts)))
    left, out = list(rules), []
    while left:
        rule, _, flags = best(estimate(texts, left))
        rule.rejects(texts)  # the features that it needs are known from here on
        texts = texts.take(np.flatnonzero(~flags))
        left.remove(rule)
        out.append(rule)
    return out


def cascade(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """Index of the rejecting rule per text, -1 if every rule let it pass."""
    verdict = np.full(len(texts), -1)
    alive = np.arange(len(texts))
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        out = rule.rejects(texts)
        verdict[alive[out]] = i
        if out.any():
            alive, texts = alive[~out], texts.take(np.flatnonzero(~out))
    return verdict


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{c} long" for c in ("doc_id", *STATS)) + ", base_failed boolean, kept boolean, rejected_by string"


def sampled(docs: DataFrame, size: int = SAMPLE) -> pa.ChunkedArray:
    """About `size` texts, drawn over all rows."""
    n = docs.count()
    return docs.select("text").sample(min(1.0, size / max(n, 1)), seed=17).toArrow().column("text")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: pa.ChunkedArray | None = None) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the rule that rejected it (it depends on the order)."""
    order = ordered(sampled(docs) if sample is None else sample, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in chunks.slices(pa.Table.from_batches([batch])):
                texts = Texts(table.column("text"))
                failed = base_failed(texts)
                columns = {c: getattr(texts, c) for c in STATS}
                passed = np.flatnonzero(~failed)
                verdict = np.full(len(texts), -1)
                verdict[passed] = cascade(texts.take(passed), order)
                names = ["base" if f else order[v].name if v >= 0 else None for f, v in zip(failed, verdict)]
                out = {"doc_id": table.column("doc_id"), **columns, "base_failed": failed, "kept": ~failed & (verdict < 0), "rejected_by": pa.array(names, pa.string())}
                yield from pa.table(out).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: pa.ChunkedArray | None = None) -> DataFrame:
    """The rows, with all their columns, that pass the base test and every rule."""
    order = ordered(sampled(docs) if sample is None else sample, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in chunks.slices(pa.Table.from_batches([batch])):
                texts = Texts(table.column("text"))
                passed = np.flatnonzero(~base_failed(texts))
                good = passed[cascade(texts.take(passed), order) < 0]
                yield from table.take(pa.array(good)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the rules that SQL states, with the stems that are frequent in the table's toxic documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, rules_for(docs, labels)).drop("rejected_by")


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
SQL = rf"""
WITH d AS (SELECT doc_id, lang, text, {_W} AS w, {_LINES} AS l, {_PLAIN} AS plain FROM documents),{toxicity.FREQUENT_SQL},
g AS (SELECT doc_id, p, w[p : p + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS letters,
             len(l) AS n_lines, doc_id IN (SELECT doc_id FROM toxic) AS is_toxic
      FROM d LEFT JOIN hit USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * upper <= 3 * letters AND 10 * n_dup_lines <= 3 * n_lines AND NOT is_toxic AS kept
FROM b
"""
