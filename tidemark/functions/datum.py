"""Data in the detailed JSON schema, read as typed nodes and written again.

A datum is {"int": n}, {"bytes": "hex"}, {"list": [datum...]}, {"map": [{"k": datum, "v": datum}...]} or {"constructor": n,
"fields": [datum...]}. It is parsed once, as VARIANT, and taken apart level by level, `depth` levels at most, so that any
number of data of bounded depth is a few projections. What is wrong with a node is told in its `error`, and what lies below
such a node is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 8
#: Data of a task: taking them apart is work for many tasks even where they lie in few blocks of files.
ROWS = 10_000
NOT_JSON, UNKNOWN, NOT_WHOLE, NOT_HEX, NOT_LIST, NOT_PAIRS, TOO_DEEP = "not JSON", "unknown form", "not a whole number", "not bytes in hexadecimal digits", "not a list", "not a list of pairs", "too deep"


_CONTAINERS = {"list": '{"list":[', "map": '{"map":['}


def _taken_apart(level: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes that are done, and in place of each that is not: itself, done, and its children."""
    done, kind, fine = F.col("done"), F.col("_kind"), F.col("_error").isNull() & ~F.col("done")
    part = lambda name: F.try_element_at("_m", F.lit(name))
    form = F.array_join(F.array_sort(F.map_keys("_m")), ",")
    own = F.when(form.isin("int", "bytes", "list", "map"), form).when(form == "constructor,fields", "constructor")
    at = level.withColumn("_m", F.when(~done, F.try_variant_get("v", "$", "map<string,variant>"))).withColumn("_kind", own)
    number = F.when(kind == "int", part("int")).when(kind == "constructor", part("constructor"))
    many = F.when(kind == "list", part("list")).when(kind == "constructor", part("fields")).when(kind == "map", part("map"))
    at = at.withColumns({"_number": number, "_many": many, "_bytes": F.when(kind == "bytes", part("bytes"))})
    at = at.withColumns({"_items": F.try_variant_get("_many", "$", "array<variant>"), "_pairs": F.when(kind == "map", F.try_variant_get("_many", "$", "array<map<string,variant>>"))})
    text = F.try_variant_get("_bytes", "$", "string")
    whole = F.coalesce(F.schema_of_variant("_number").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), F.lit(False))
    good = F.coalesce(F.forall("_pairs", lambda p: (F.size(p) == 2) & F.map_contains_key(p, "k") & F.map_contains_key(p, "v")), F.lit(False))
    error = (
        F.when(done, F.col("error"))
        .when(F.col("v").isNull(), NOT_JSON)
        .when(kind.isNull(), UNKNOWN)
        .when(kind.isin("int", "constructor") & ~whole, NOT_WHOLE)
        .when((kind == "constructor") & (F.try_variant_get("_number", "$", "decimal(38,0)") < 0), NOT_WHOLE)
        .when((kind == "bytes") & ~F.coalesce((F.schema_of_variant("_bytes") == "STRING") & text.rlike("^([0-9a-f]{2})*$"), F.lit(False)), NOT_HEX)
        .when(kind.isin("list", "constructor", "map") & F.col("_items").isNull(), NOT_LIST)
        .when((kind == "map") & ~good, NOT_PAIRS)
    )
    at = at.withColumn("_error", error)
    value = F.when(done, F.col("value")).when(fine & kind.isin("int", "constructor"), F.try_variant_get("_number", "$", "string")).when(fine & (kind == "bytes"), text)
    inner = F.when(fine, F.when(kind == "map", F.flatten(F.transform("_pairs", lambda p: F.array(F.element_at(p, F.lit("k")), F.element_at(p, F.lit("v")))))).otherwise(F.col("_items")))
    last, itself = F.element_at(F.concat(F.array(F.lit(0)), "path"), -1), F.array(F.lit(None).cast("variant"))
    # what closes a node, after those below it
    shut = F.concat(F.when(kind.isin("list", "map", "constructor"), "]}").otherwise(""), F.when((F.col("up") == "map") & (last % 2 == 1), "}").otherwise(""))
    at = at.select(
        *keys, "path", "up", F.when(done, F.col("shut")).otherwise(F.array_append("shut", shut)).alias("shut"), F.when(done, F.col("kind")).otherwise(kind).alias("kind"),
        value.alias("value"), F.col("_error").alias("error"), F.coalesce(F.concat(itself, inner), itself).alias("_all"),
    )
    # the node comes first, its children after it; there always is one, and an outer explode adds no filter that makes them again
    at, first = at.select(*keys, "path", "up", "shut", "kind", "value", "error", F.posexplode_outer("_all").alias("_i", "v")), F.col("_i") == 0
    return at.select(
        *keys, F.when(first, F.col("path")).otherwise(F.array_append("path", F.col("_i") - 1)).alias("path"), F.when(first, F.col("up")).otherwise(F.col("kind")).alias("up"), "shut",
        F.when(first, F.col("kind")).alias("kind"), F.when(first, F.col("value")).alias("value"), "error", "v", first.alias("done"),
    )


def nodes(rows: DataFrame, keys: list[str], datum: str, depth: int = DEPTH) -> DataFrame:
    """The nodes of each datum: the keys, path (places of children from the root), kind, value and error; and for `written`
    the kind of the node above and what closes the nodes on the path. Data are dealt by their keys first, so `written` deals
    no nodes."""
    none = F.lit(None).cast("string")
    given = rows.where(F.col(datum).isNotNull()).select(*keys, datum)
    dealt = given.repartition(max(1, -(-given.count() // ROWS)), *keys)
    level = dealt.select(
        *keys, F.array().cast("array<int>").alias("path"), none.alias("up"), F.array().cast("array<string>").alias("shut"), none.alias("kind"), none.alias("value"), none.alias("error"),
        F.try_parse_json(datum).alias("v"), F.lit(False).alias("done"),
    )
    for _ in range(depth):
        level = _taken_apart(level, keys)
    return level.select(*keys, "path", "kind", "value", F.when(F.col("done"), F.col("error")).otherwise(TOO_DEEP).alias("error"), "up", "shut")


def written(found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with the datum that the nodes make up, in its shortest JSON, or null and the first error of its nodes.

    A path sorts before those below it, so the nodes of a datum in order of paths are its text from left to right."""
    last, kind, value = F.element_at(F.concat(F.array(F.lit(0)), "path"), -1), F.col("kind"), F.col("value")
    comma = F.when(last > 0, ",").otherwise("")
    before = F.when(F.col("up") == "map", F.when(last % 2 == 1, ',"v":').otherwise(F.concat(comma, F.lit('{"k":')))).when(F.col("up").isNotNull(), comma).otherwise("")
    begin = (
        F.when(kind == "int", F.concat(F.lit('{"int":'), value, F.lit("}")))
        .when(kind == "bytes", F.concat(F.lit('{"bytes":"'), value, F.lit('"}')))
        .when(kind == "constructor", F.concat(F.lit('{"constructor":'), value, F.lit(',"fields":[')))
    )
    for name, start in _CONTAINERS.items():
        begin = begin.when(kind == name, start)
    one = F.struct("path", F.concat(before, begin).alias("begin"), "shut")
    per = found.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("path"))).alias("error"))
    # after a node all close that the next one does not lie below
    size = lambda i: F.coalesce(F.size(F.get("all", i)["path"]), F.lit(0))
    ends = lambda x, i: F.array_join(F.reverse(F.slice(x["shut"], F.greatest(F.when(i + 1 < F.size("all"), size(i + 1)).otherwise(0), F.lit(0)) + 1, F.greatest(F.size(x["path"]) - F.when(i + 1 < F.size("all"), size(i + 1)).otherwise(0) + 1, F.lit(0)))), "")
    text = F.array_join(F.transform("all", lambda x, i: F.concat(x["begin"], ends(x, i))), "")
    return per.select(*keys, F.when(F.col("error").isNull(), text).alias("datum"), "error")
