"""URL filters by a temporal list join, with Spark SQL functions only.

Dated list entries (kind, pattern, action, at) become validity intervals: per pattern, an 'add' opens an interval at its
date and the next 'remove' closes it before its date. An as-of join evaluates every capture against the entries that
were active when it was fetched. Kinds: 'domain' matches a host and all hosts below it; 'prefix' matches a host with a
path up to a whole segment.

Every capture looks up its own keys (its host's suffixes, its path's prefixes), so the join is by equality on
(kind, pattern) with one row per pattern on the list's side; captures are salted and that row is repeated per salt, so
a host that a third of all captures share is spread over SALTS tasks. Only keys of as many labels or segments as some
pattern of the list has are made, so a URL of 100,000 segments costs no more than its length times those few sizes.

Defined results: a null or unparsable URL has no host and matches nothing; a null fetch date matches nothing; on one
date a 'remove' counts after an 'add'; repeated entries count once; entries with a null field and unknown actions are
ignored; an empty list keeps every capture; repeated captures are judged one by one; an empty table of captures gives an
empty one; other columns, whatever their names, are ignored. The host of a bracketed address is the address in its brackets.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)"


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """One row per (kind, pattern): its intervals as array<struct<since, until>>; an open one has a null `until`."""
    clean = entries.where("kind is not null and pattern is not null and at is not null and action in ('add', 'remove')").select("kind", "pattern", "at", (F.col("action") == "add").alias("adds"))
    # on one date the removal wins; a run of equal actions keeps its first date
    dated = clean.groupBy("kind", "pattern", "at").agg(F.min("adds").alias("adds"))
    order = Window.partitionBy("kind", "pattern").orderBy("at")
    changed = dated.withColumn("was", F.lag("adds", 1, False).over(order)).where("adds <> was")
    closed = changed.withColumn("until", F.lead("at").over(order)).where("adds")
    return closed.groupBy("kind", "pattern").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("since"), "until"))).alias("spans"))


def sizes(listed: DataFrame) -> Column:
    """The distinct (kind, labels or segments) of the patterns, as one scalar subquery. Patterns of n different sizes have
    n * n / 2 characters at least, so even a list of 10 GB has under 150,000."""
    parts = F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\."))).otherwise(F.size(F.split("pattern", "/")) - 1)
    return listed.select(F.struct("kind", parts.alias("n")).alias("s")).agg(F.array_sort(F.collect_set("s"))).scalar()


def keys(url: str | Column, known: Column) -> Column:
    """The (kind, pattern) pairs that can match a URL, of the sizes in `known`."""
    name = host(url)
    labels = F.split(name, r"\.")
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda p: p != "")

    def of(kind: str, many: Column, pattern) -> Column:
        own = F.filter(known, lambda s: (s["kind"] == kind) & (s["n"] > 0) & (s["n"] <= many))
        return F.transform(own, lambda s: F.struct(F.lit(kind).alias("kind"), pattern(s["n"]).alias("pattern")))

    domains = of("domain", F.size(labels), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = of("prefix", F.size(parts), lambda n: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    none = F.expr("cast(array() as array<struct<kind:string,pattern:string>>)")
    return F.when(name == "", none).otherwise(F.concat(domains, prefixes))


def active_entries(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """A row per capture: its columns id, url, fetched_at, and `matches`, the active entries' (kind, pattern, since)."""
    own = ["id", "url", "fetched_at"]
    salt = F.pmod(F.xxhash64("id", "fetched_at"), F.lit(SALTS)).alias("salt")
    listed = intervals(entries)
    sized = captures.select(*own, salt, sizes(listed).alias("known"))
    asked = sized.select(*own, "salt", F.explode(keys("url", F.col("known"))).alias("k")).select(*own, "salt", "k.kind", "k.pattern")
    listed = listed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    hit = F.filter("spans", lambda s: (s["since"] <= F.col("fetched_at")) & (s["until"].isNull() | (s["until"] > F.col("fetched_at"))))
    found = asked.join(listed, ["kind", "pattern", "salt"]).select(*own, "kind", "pattern", F.get(hit, F.lit(0))["since"].alias("since")).where("since is not null")
    per = found.groupBy(*(F.col(c).alias(f"of_{c}") for c in own)).agg(F.array_sort(F.collect_set(F.struct("kind", "pattern", "since"))).alias("matches"))
    none = F.expr("cast(array() as array<struct<kind:string,pattern:string,since:date>>)")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in own))
    return captures.select(*own).join(per, same, "left").select(*own, F.coalesce("matches", none).alias("matches"))


def _code(text: Column) -> Column:
    """A number that SQL engines agree on."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def feed(pages: DataFrame) -> DataFrame:
    """The query's list: a rule over the hosts and first path segments that the table has, so it grows with the table.

    Three hosts in ten are added, some removed later and some added again; one first path segment in ten is added.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    names = pages.select(host("url").alias("pattern")).where("pattern <> ''").distinct().withColumn("c", _code(F.col("pattern")))
    first = F.pmod(F.col("c"), F.lit(240))
    step = lambda action, at, most: F.struct(F.lit(action).alias("action"), day(at).alias("at"), F.lit(most).alias("most"))
    steps = F.array(step("add", first, 2), step("remove", first + 30, 1), step("add", first + 90, 0))
    which = F.pmod(F.col("c"), F.lit(10))
    hosts = names.select("pattern", which.alias("which"), F.explode(steps).alias("s")).where("which <= s.most").select(F.lit("domain").alias("kind"), "pattern", "s.action", "s.at")
    part = F.split(F.regexp_extract(F.coalesce("url", F.lit("")), PATH, 1), "/")[0]
    paths = pages.select(F.concat(host("url"), F.lit("/"), part).alias("pattern"), host("url").alias("h"), part.alias("p")).where("h <> '' and p <> ''").select("pattern").distinct().withColumn("c", _code(F.col("pattern")))
    prefixes = paths.where(F.pmod(F.col("c"), F.lit(10)) == 0).select(F.lit("prefix").alias("kind"), "pattern", F.lit("add").alias("action"), day(F.pmod(F.col("c"), F.lit(300))).alias("at"))
    return hosts.unionByName(prefixes)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page n counts as fetched on day n mod 365 of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    found = active_entries(pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched_at")), feed(pages))
    names = F.array_join(F.transform("matches", lambda m: F.concat(m["kind"], F.lit(" "), m["pattern"], F.lit(" "), m["since"].cast("string"))), ",")
    return found.select(F.col("id").alias("page_id"), "url", F.col("fetched_at").cast("string").alias("fetched_on"), F.size("matches").cast("long").alias("n_entries"), names.alias("entries"), (F.size("matches") == 0).alias("kept"))


_MD5 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
SQL = rf"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS f,
                  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]+)', 1)) AS h,
                  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
                  string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1), '/')[1] AS part FROM pages),
hosts AS (SELECT h AS pattern, {_MD5.format("h")} AS c FROM (SELECT DISTINCT h FROM p WHERE h <> '')),
paths AS (SELECT x AS pattern, {_MD5.format("x")} AS c FROM (SELECT DISTINCT h || '/' || part AS x FROM p WHERE h <> '' AND part <> '')),
listed AS (
    SELECT 'domain' AS kind, pattern, DATE '2024-01-01' + CAST(c % 240 AS INT) AS since, CASE WHEN c % 10 <= 1 THEN DATE '2024-01-01' + CAST(c % 240 + 30 AS INT) END AS until FROM hosts WHERE c % 10 <= 2
    UNION ALL SELECT 'domain', pattern, DATE '2024-01-01' + CAST(c % 240 + 90 AS INT), NULL FROM hosts WHERE c % 10 = 0
    UNION ALL SELECT 'prefix', pattern, DATE '2024-01-01' + CAST(c % 300 AS INT), NULL FROM paths WHERE c % 10 = 0),
k AS (
    SELECT page_id, f, 'domain' AS kind, array_to_string(string_split(h, '.')[i:], '.') AS pattern
    FROM (SELECT page_id, f, h, unnest(range(1, len(string_split(h, '.')) + 1)) AS i FROM p WHERE h <> '')
    UNION ALL SELECT page_id, f, 'prefix', h || '/' || array_to_string(parts[:i], '/')
    FROM (SELECT page_id, f, h, parts, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE h <> '')),
m AS (SELECT DISTINCT page_id, kind, pattern, since FROM k JOIN listed USING (kind, pattern) WHERE since <= f AND (until IS NULL OR until > f)),
g AS (SELECT page_id, count(*) AS n, string_agg(kind || ' ' || pattern || ' ' || CAST(since AS VARCHAR), ',' ORDER BY kind, pattern, since) AS s FROM m GROUP BY page_id)
SELECT page_id, url, CAST(f AS VARCHAR) AS fetched_on, coalesce(n, 0) AS n_entries, coalesce(s, '') AS entries, n IS NULL AS kept FROM p LEFT JOIN g USING (page_id)
"""
