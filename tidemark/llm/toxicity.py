"""Word stems that mark toxic text, fitted on a table's own labelled documents, language by language.

A stem is a beginning of a word, of STEM characters, that SEEN per cent of a language's toxic documents hold and that makes
up MORE times the share of their words that it has in the language's other documents, and ELSEWHERE times that of any
other language where it is more common. A text is toxic if the stems of one
language make up more of its words than that language's cut: halfway from what all but TAIL per cent of the other documents
have at most, in the language that has most, to what all but LOW per cent of its toxic ones have at least. Words are
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, with A-Z lower-cased.

The fit reads whole texts of PER_CLASS toxic and PER_CLASS other documents at most, a documented bound on labelled rows; the
verdicts read every text. A language with fewer than LEAST labelled documents of either kind, or whose toxic documents do not
stand out, has no stems, and no text is toxic by them: there is no list of words in the code.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

PER_CLASS, LEAST = 2000, 10
STEM, SEEN, MORE, ELSEWHERE, TAIL, LOW = (4, 8), 15, 20, 100, 3, 25
#: Shares of words are whole numbers, in parts of this.
ONE = 1_000_000


@dataclasses.dataclass(frozen=True)
class Stems:
    stems: tuple[str, ...]
    cut: int


def frequent(docs: DataFrame, labels: DataFrame) -> dict[str, Stems]:
    """The stems of each language, from PER_CLASS toxic and PER_CLASS other labelled documents at most, the first in the order
    of md5(doc_id). The driver gets the stems, at most 100 / SEEN times those of a mean document, and shares of the sample."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"))
    zero, one = (known.where(F.col("toxic") == t).orderBy(*order).limit(PER_CLASS) for t in (0, 1))
    plain = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    # written first: a filter on the words would else be pushed below the join, to every document
    read = written(docs.select("doc_id", "lang", "text").join(F.broadcast(zero.union(one)), "doc_id").where("text is not null"), "labelled")
    read = read.select("doc_id", "lang", "toxic", plain.alias("w"))
    words = read.select("doc_id", "lang", "toxic", F.size("w").alias("n"), F.explode("w").alias("y")).groupBy("doc_id", "lang", "toxic", "n", "y").agg(F.count("*").alias("k"))
    sized = words.select("*", F.explode(F.sequence(*map(F.lit, STEM))).alias("l")).where(F.length("y") >= F.col("l"))
    own = sized.groupBy("doc_id", "lang", "toxic", "n", F.expr("substring(y, 1, l)").alias("stem")).agg(F.sum("k").alias("k"))
    share = F.floor(F.col("k") * ONE / F.col("n")).cast("long")
    many = words.select("doc_id", "lang", "toxic").distinct().groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("nt"), F.count_if(F.col("toxic") == 0).alias("nc"))
    sums = own.groupBy("lang", "stem").agg(
        F.count_if(F.col("toxic") == 1).alias("held"),
        F.sum(F.when(F.col("toxic") == 1, share).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, share).otherwise(0)).alias("good"),
    )
    # the mean share of the words of other documents, in the language that has most of it
    means = sums.join(F.broadcast(many), "lang").withColumn("mean", F.expr("good div nullif(nc, 0)"))  # a row per language
    worst = means.groupBy("stem").agg(F.max("mean").alias("worst"))
    found = means.join(worst, "stem").where((F.col("nt") >= LEAST) & (F.col("nc") >= LEAST) & (100 * F.col("held") >= SEEN * F.col("nt")) & (F.col("bad") >= F.when(F.col("worst") > F.col("mean"), ELSEWHERE).otherwise(MORE) * F.col("worst") * F.col("nt")))
    found = written(found.select(F.col("lang").alias("of"), "stem"), "stems")
    stems = {r.of: tuple(r.stems) for r in found.groupBy("of").agg(F.sort_array(F.collect_list("stem")).alias("stems")).collect()}
    hits = sized.withColumn("stem", F.expr("substring(y, 1, l)")).join(found, "stem").select("doc_id", "lang", "toxic", "n", "y", "k", "of").distinct()
    shares = hits.groupBy("doc_id", "lang", "toxic", "n", "of").agg(F.sum("k").alias("k")).withColumn("share", share)
    lists = {(r.of, r.lang, r.toxic): r.s for r in shares.where("lang is not null").groupBy("of", "lang", "toxic").agg(F.sort_array(F.collect_list("share"), asc=False).alias("s")).collect()}
    sizes = {r.lang: (r.nc, r.nt) for r in many.collect()}
    nth = lambda values, i: values[i] if i < len(values) else 0
    out = {}
    for of, own in stems.items():
        high = max(nth(lists.get((of, lang, 0), []), nc * TAIL // 100) for lang, (nc, _) in sizes.items())
        nt = sizes[of][1]
        low = nth(lists.get((of, of, 1), []), nt - nt * LOW // 100 - 1)
        if low > high:
            out[of] = Stems(own, (low + high) // 2)
    return out


#: `frequent` and its verdicts in DuckDB's SQL, over d (doc_id, lang, plain); `toxic` has the ids.
FREQUENT_SQL = f"""
pick AS (SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS r
         FROM (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IN (0, 1) GROUP BY doc_id)) WHERE r <= {PER_CLASS}),
dw AS (SELECT doc_id, lang, len(plain) AS n, y, count(*) AS k FROM (SELECT doc_id, lang, plain, unnest(plain) AS y FROM d) GROUP BY ALL),
cut AS (SELECT *, substring(y, 1, l) AS stem FROM dw, (SELECT unnest(range({STEM[0]}, {STEM[1]} + 1)) AS l) WHERE length(y) >= l),
own AS (SELECT doc_id, lang, toxic, stem, CAST(floor(sum(k) * {ONE} / n) AS BIGINT) AS share FROM cut JOIN pick USING (doc_id) GROUP BY doc_id, lang, toxic, n, stem),
many AS (SELECT lang, count(*) FILTER (toxic = 1) AS nt, count(*) FILTER (toxic = 0) AS nc FROM (SELECT DISTINCT doc_id, lang, toxic FROM dw JOIN pick USING (doc_id)) GROUP BY lang),
means AS (SELECT lang, stem, nt, nc, count(*) FILTER (toxic = 1) AS held, coalesce(sum(share) FILTER (toxic = 1), 0) AS bad, coalesce(sum(share) FILTER (toxic = 0), 0) // nullif(nc, 0) AS mean
          FROM own JOIN many USING (lang) GROUP BY lang, stem, nt, nc),
stems AS (SELECT lang, stem FROM means JOIN (SELECT stem, max(mean) AS worst FROM means GROUP BY stem) USING (stem) WHERE nt >= {LEAST} AND nc >= {LEAST} AND 100 * held >= {SEEN} * nt AND bad >= CASE WHEN worst > mean THEN {ELSEWHERE} ELSE {MORE} END * worst * nt),
hits AS (SELECT DISTINCT doc_id, cut.lang, n, y, k, stems.lang AS of FROM cut JOIN stems USING (stem)),
shares AS (SELECT of, lang, toxic, doc_id, CAST(floor(sum(k) * {ONE} / n) AS BIGINT) AS share FROM hits JOIN pick USING (doc_id) WHERE lang IS NOT NULL GROUP BY of, lang, toxic, doc_id, n),
lists AS (SELECT of, lang, toxic, list(share ORDER BY share DESC) AS s FROM shares GROUP BY ALL),
high AS (SELECT of, max(coalesce(s[nc * {TAIL} // 100 + 1], 0)) AS c FROM lists JOIN many USING (lang) WHERE toxic = 0 GROUP BY of),
low AS (SELECT of, coalesce(s[nt - nt * {LOW} // 100], 0) AS t FROM lists JOIN many USING (lang) WHERE toxic = 1 AND of = lang),
cuts AS (SELECT of, (t + coalesce(c, 0)) // 2 AS cut FROM low LEFT JOIN high USING (of) WHERE t > coalesce(c, 0)),
toxic AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, n, of, sum(k) AS h FROM hits GROUP BY doc_id, n, of) JOIN cuts USING (of) WHERE {ONE} * h > cut * n)"""
