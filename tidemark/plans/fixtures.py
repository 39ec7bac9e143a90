"""The driver's tables read as a chain: blocks and a change log from events; outputs, spends, data and blocks from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots count days from here.
EPOCH = "1995-01-01"
#: Every so many events the chain goes back by so many slots.
ROLLBACK_EVERY, ROLLBACK_BY = 97, 5
#: Slots of an epoch of the order chain.
EPOCH_SLOTS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _md5(c: Column) -> Column:
    return F.md5(c.cast("string").cast("binary"))


def _day(c: str, start: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit(start).cast("date")).cast("bigint")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per event."""
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(n.alias("slot_no"), _md5(n).alias("block_hash"), n.alias("block_no"), _day("ts", "2024-01-01").alias("epoch_no"), seconds.alias("ts"), "user_id", "event_type")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    none = F.lit(None).cast("bigint")
    forward = F.struct((n * 2).alias("seq"), F.lit("INDEX").alias("op"), n.alias("slot_no"), n.alias("block_no"), none.alias("to_slot"))
    back = F.struct((n * 2 + 1).alias("seq"), F.lit("ROLLBACK").alias("op"), none.alias("slot_no"), none.alias("block_no"), (n - ROLLBACK_BY).alias("to_slot"))
    rows = F.when(n % ROLLBACK_EVERY == 0, F.array(forward, back)).otherwise(F.array(forward))
    return table(spark, sf_dir, "events").select(F.explode(rows).alias("r")).select("r.*")


def block_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per day with orders; the days of a calendar are few, so numbering them takes one small window."""
    from pyspark.sql.window import Window

    days = table(spark, sf_dir, "orders").select(_day("o_orderdate", EPOCH).alias("slot_no")).distinct()
    number = F.row_number().over(Window.orderBy("slot_no")).cast("bigint")
    return days.select("slot_no", number.alias("block_no"), (F.col("slot_no") * 86400 + 788918400).alias("block_timestamp"), F.floor(F.col("slot_no") / EPOCH_SLOTS).cast("bigint").alias("epoch_no"))


def _lines(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """A row per line with the slot of its order; `orders` (tx_id, slot_no and more) may bring more of it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate").repartition("l_orderkey")  # dealt once, for all that goes by order
    per = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("address"), F.min("l_partkey").alias("part"), F.sum("l_quantity").alias("value"), F.min("l_returnflag").alias("flag"), F.max("l_shipdate").alias("shipped"))
    if orders is None:
        orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), _day("o_orderdate", EPOCH).alias("slot_no"))
    lines = per.select(F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").alias("tx_ix"), "address", "part", "value", "flag", _day("shipped", EPOCH).alias("spent_slot"))
    return lines.join(orders, "tx_id")


def utxo(spark: SparkSession, sf_dir: str) -> DataFrame:
    datum = F.when(F.col("flag") != "N", _md5(F.col("part")))
    return _lines(spark, sf_dir).select("tx_id", "tx_ix", "address", "value", "slot_no", datum.alias("datum_hash"))


def spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))  # one row
    rows = _lines(spark, sf_dir).where(F.col("spent_slot") > F.col("slot_no")).join(F.broadcast(many))
    return rows.select("tx_id", "tx_ix", ((F.col("tx_id") * 7 + F.col("tx_ix")) % F.col("n")).alias("spent_at_tx"), F.col("spent_slot").alias("slot_no"))


def datum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data of the parts, first seen where an output first refers to them."""
    seen = utxo(spark, sf_dir).where("datum_hash is not null").groupBy("datum_hash").agg(F.min("slot_no").alias("slot_no"))
    parts = table(spark, sf_dir, "part").select(_md5(F.col("p_partkey")).alias("datum_hash"), F.col("p_name").alias("datum"))
    return parts.join(seen, "datum_hash")


def mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase mints, an error burns."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return rows.select(n.alias("slot_no"), n.alias("block_no"), n.alias("tx_id"), (n % 3).alias("tx_index"), F.col("user_id").alias("policy_id"), F.col("event_type").alias("asset_name"), F.when(F.col("event_type") == "purchase", k).otherwise(-k).alias("quantity"))


def sdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stake per epoch and pool, in cents; a pool is a bucket of customers."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    epoch = F.floor(_day("o_orderdate", EPOCH) / EPOCH_SLOTS).cast("bigint")
    rows = table(spark, sf_dir, "orders").select(epoch.alias("epoch_no"), (F.col("o_custkey") % 20).alias("pool_id"), cents.alias("c"))
    return rows.groupBy("epoch_no", "pool_id").agg(F.sum("c").alias("lovelace"))


def address_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utxo(spark, sf_dir).groupBy("address", "slot_no").agg(F.count("*").alias("count"))


#: The same tables in DuckDB's SQL.
SQL = {
    "blocks": "SELECT event_id AS slot_no, md5(event_id::VARCHAR) AS block_hash, event_id AS block_no, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch_no, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type FROM events",
    "log": f"SELECT 2 * event_id AS seq, 'INDEX' AS op, event_id AS slot_no, event_id AS block_no, NULL::BIGINT AS to_slot FROM events UNION ALL SELECT 2 * event_id + 1, 'ROLLBACK', NULL, NULL, event_id - {ROLLBACK_BY} FROM events WHERE event_id % {ROLLBACK_EVERY} = 0",
    "valid": "SELECT seq, slot_no, block_no FROM (SELECT *, min(CASE WHEN op = 'ROLLBACK' THEN to_slot END) OVER (ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM log) WHERE op = 'INDEX' AND (m IS NULL OR m >= slot_no)",
    "block_info": f"SELECT slot_no, row_number() OVER (ORDER BY slot_no) AS block_no, slot_no * 86400 + 788918400 AS block_timestamp, CAST(floor(slot_no / {EPOCH_SLOTS}.0) AS BIGINT) AS epoch_no FROM (SELECT DISTINCT date_diff('day', DATE '{EPOCH}', o_orderdate::DATE) AS slot_no FROM orders)",
    "lines": f"SELECT l_orderkey AS tx_id, l_linenumber AS tx_ix, min(l_suppkey) AS address, min(l_partkey) AS part, sum(l_quantity) AS value, min(l_returnflag) AS flag, date_diff('day', DATE '{EPOCH}', max(l_shipdate)::DATE) AS spent_slot, date_diff('day', DATE '{EPOCH}', any_value(o_orderdate)::DATE) AS slot_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "utxo": "SELECT tx_id, tx_ix, address, value, slot_no, CASE WHEN flag <> 'N' THEN md5(part::VARCHAR) END AS datum_hash FROM lines",
    "spent": "SELECT tx_id, tx_ix, (tx_id * 7 + tx_ix) % (SELECT count(*) FROM orders) AS spent_at_tx, spent_slot AS slot_no FROM lines WHERE spent_slot > slot_no",
    "datum": "SELECT datum_hash, p_name AS datum, slot_no FROM (SELECT md5(p_partkey::VARCHAR) AS datum_hash, p_name FROM part) JOIN (SELECT datum_hash, min(slot_no) AS slot_no FROM utxo WHERE datum_hash IS NOT NULL GROUP BY 1) USING (datum_hash)",
    "mint": "SELECT event_id AS slot_no, event_id AS block_no, event_id AS tx_id, event_id % 3 AS tx_index, user_id AS policy_id, event_type AS asset_name, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * CAST(json_extract_string(props, '$.k') AS BIGINT) AS quantity FROM events WHERE event_type IN ('purchase', 'error')",
    "sdd": f"SELECT CAST(floor(date_diff('day', DATE '{EPOCH}', o_orderdate::DATE) / {EPOCH_SLOTS}.0) AS BIGINT) AS epoch_no, o_custkey % 20 AS pool_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS lovelace FROM orders GROUP BY 1, 2",
    "address_counts": "SELECT address, slot_no, count(*) AS count FROM utxo GROUP BY 1, 2",
}
_NEEDS = {"valid": ["log"], "utxo": ["lines"], "spent": ["lines"], "datum": ["lines", "utxo"], "address_counts": ["lines", "utxo"]}


def sql(body: str, *names: str) -> str:
    """A query over the named tables."""
    wanted: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    if not wanted:
        return body
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + " " + body
