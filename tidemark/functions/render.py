"""How values look at the edge: references, hashes, asset maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def references(column: str) -> Column:
    """[(tx_id, tx_ix)] as 'tx#ix,tx#ix'."""
    return F.array_join(F.transform(column, lambda r: F.concat(r["tx_id"].cast("string"), F.lit("#"), r["tx_ix"].cast("string"))), ",")


def parse_references(column: str | Column) -> Column:
    """The reverse of `references`, as strings and ints."""
    parts = F.filter(F.split(column, ","), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, "#")[0].alias("tx_id"), F.split(p, "#")[1].cast("int").alias("tx_ix")))


def lower_hex(column: str | Column) -> Column:
    return F.lower(F.hex(column))


def quoted(text: str | Column) -> Column:
    """A JSON string: quotes, backslashes and control characters are escaped."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def datum_json(column: str | Column) -> Column:
    """A datum's detailed JSON in one form: no white space, keys in order; null for what is no JSON."""
    return F.to_json(F.try_parse_json(column))


def asset_json(column: str) -> Column:
    """[(asset_name, q)] as a JSON object in the list's order."""
    pairs = F.transform(column, lambda a: F.concat(quoted(a["asset_name"]), F.lit(":"), a["q"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def value_json(column: str | Column) -> Column:
    """A multi-asset value, policy to asset to quantity, as a JSON object with sorted keys."""
    order = lambda m: F.map_from_arrays(F.array_sort(F.map_keys(m)), F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k)))
    return F.to_json(F.transform_values(order(F.col(column) if isinstance(column, str) else column), lambda _, assets: order(assets)))
