"""Every registered query of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import render
from tidemark.operators import changelog, generic, preprocess
from tidemark.plans import domain
from tidemark.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Fixed parameters of the queries: two slots and an address of the order chain, a slot and a policy of the event chain,
#: security depth.
SLOT, EARLY, ADDRESS, AT, POLICY, DEPTH = 1000, 19, 3, 800, 8, 50


def query(sql: str | None, *tables: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = fx.sql(sql, *tables)
        return f

    return register


# --- outputs and spends


@query(f"SELECT tx_id, tx_ix, address, value, slot_no FROM utxo u WHERE slot_no <= {SLOT} AND NOT EXISTS (SELECT 1 FROM spent s WHERE s.tx_id = u.tx_id AND s.tx_ix = u.tx_ix AND s.slot_no <= {SLOT})", "utxo", "spent")
def unspent_as_of(spark, sf):
    return domain.unspent(fx.utxo(spark, sf), fx.spent(spark, sf), SLOT).select("tx_id", "tx_ix", "address", "value", "slot_no")


@query(f"SELECT tx_id, tx_ix, u.slot_no, u.value, s.spent_at_tx, s.slot_no AS spent_slot FROM utxo u LEFT JOIN spent s USING (tx_id, tx_ix) WHERE address = {ADDRESS} AND u.slot_no <= {SLOT} AND (s.slot_no IS NULL OR s.slot_no > {SLOT})", "utxo", "spent")
def utxo_unspent_by_address(spark, sf):
    made = generic.until(fx.utxo(spark, sf).where(F.col("address") == ADDRESS), SLOT)
    return domain.unspent_with_spend(made, fx.spent(spark, sf), SLOT).select("tx_id", "tx_ix", "slot_no", "value", "spent_at_tx", "spent_slot")


@query(
    f"""SELECT u.tx_id, u.tx_ix, u.slot_no, u.value, u.datum_hash, d.datum, b.block_no, b.epoch_no, s.spent_at_tx, s.slot_no AS spent_slot, f.block_no AS spent_block_no, i.tx_inputs
    FROM utxo u LEFT JOIN spent s ON s.tx_id = u.tx_id AND s.tx_ix = u.tx_ix LEFT JOIN datum d ON d.datum_hash = u.datum_hash
    LEFT JOIN (SELECT spent_at_tx, string_agg(tx_id || '#' || tx_ix, ',' ORDER BY tx_id, tx_ix) AS tx_inputs FROM spent GROUP BY 1) i ON i.spent_at_tx = u.tx_id
    LEFT JOIN block_info b ON b.slot_no = u.slot_no LEFT JOIN block_info f ON f.slot_no = s.slot_no
    WHERE address = {ADDRESS} AND u.slot_no <= {SLOT} AND (s.slot_no IS NULL OR s.slot_no > {SLOT})""",
    "utxo", "spent", "datum", "block_info",
)
def utxo_full_aggregate(spark, sf):
    out = domain.unspent_details(fx.utxo(spark, sf), fx.spent(spark, sf), fx.datum(spark, sf), fx.block_info(spark, sf), F.lit(ADDRESS), SLOT)
    inputs = F.when(F.col("tx_inputs").isNotNull(), render.references("tx_inputs")).alias("tx_inputs")
    return out.select("tx_id", "tx_ix", "slot_no", "value", "datum_hash", "datum", "block_no", "epoch_no", "spent_at_tx", "spent_slot", "spent_block_no", inputs)


def _questions(spark, sf):
    """Every order asks for an address at its day."""
    at = fx._day("o_orderdate", fx.EPOCH)
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("question"), (F.col("o_custkey") % 100 + 1).alias("address"), at.alias("at"))


_QUESTIONS = f"(SELECT o_orderkey AS question, o_custkey % 100 + 1 AS address, date_diff('day', DATE '{fx.EPOCH}', o_orderdate::DATE) AS at FROM orders) q"


@query(
    f"SELECT question, q.address, q.at, count(u.tx_id) AS n_outputs, coalesce(sum(u.value), 0) AS value FROM {_QUESTIONS} LEFT JOIN (SELECT u.*, s.slot_no AS gone FROM utxo u LEFT JOIN spent s USING (tx_id, tx_ix)) u ON u.address = q.address AND u.slot_no <= q.at AND (gone IS NULL OR gone > q.at) GROUP BY ALL",
    "utxo", "spent",
)
def utxo_balance_at_many(spark, sf):
    """As many questions as there are orders, each for an address and a slot."""
    return domain.balance_at_many(fx.utxo(spark, sf), fx.spent(spark, sf), _questions(spark, sf)).select("question", "address", "at", "n_outputs", "value")


@query(
    "SELECT u.address, s_nationkey * 100 AS at, tx_id, tx_ix, u.slot_no, gone AS spent_slot FROM supplier JOIN (SELECT u.*, s.slot_no AS gone FROM utxo u LEFT JOIN spent s USING (tx_id, tx_ix)) u ON u.address = s_suppkey AND u.slot_no <= s_nationkey * 100 AND (gone IS NULL OR gone > s_nationkey * 100)",
    "utxo", "spent",
)
def utxo_unspent_at_many(spark, sf):
    """The outputs themselves, for a slot that each address has."""
    asked = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("address"), (F.col("s_nationkey") * 100).cast("bigint").alias("at"))
    found = domain.unspent_at_many(fx.utxo(spark, sf), fx.spent(spark, sf), asked)
    return found.select("address", "at", "tx_id", "tx_ix", F.col("created").alias("slot_no"), "spent_slot")


@query(f"SELECT tx_id, tx_ix, address, slot_no FROM utxo u WHERE slot_no BETWEEN 500 AND {SLOT} AND NOT EXISTS (SELECT 1 FROM spent s WHERE s.tx_id = u.tx_id AND s.tx_ix = u.tx_ix AND s.slot_no <= {SLOT})", "utxo", "spent")
def utxo_window_bounds(spark, sf):
    return domain.unspent(fx.utxo(spark, sf), fx.spent(spark, sf), SLOT, 500).select("tx_id", "tx_ix", "address", "slot_no")


@query("SELECT tx_id, tx_ix, address, slot_no FROM utxo u WHERE NOT EXISTS (SELECT 1 FROM spent s WHERE s.tx_id = u.tx_id AND s.tx_ix = u.tx_ix)", "utxo", "spent")
def utxo_never_spent(spark, sf):
    return domain.unspent(fx.utxo(spark, sf), fx.spent(spark, sf), None).select("tx_id", "tx_ix", "address", "slot_no")


@query(f"SELECT tx_id, tx_ix, address, value FROM utxo WHERE slot_no = {SLOT}", "utxo")
def utxo_at_slot(spark, sf):
    return generic.event_at(fx.utxo(spark, sf), SLOT).select("tx_id", "tx_ix", "address", "value")


@query("SELECT tx_id, tx_ix, address, slot_no FROM utxo WHERE slot_no = (SELECT max(slot_no) FROM utxo)", "utxo")
def utxo_latest(spark, sf):
    return domain.latest_outputs(fx.utxo(spark, sf)).select("tx_id", "tx_ix", "address", "slot_no")


@query(f"SELECT tx_id, tx_ix, value * 2 AS doubled, slot_no FROM utxo WHERE slot_no <= {SLOT} AND value > 40", "utxo")
def utxo_matching(spark, sf):
    return generic.events_matching(fx.utxo(spark, sf), SLOT, F.col("value") > 40, F.col("tx_id"), F.col("tx_ix"), (F.col("value") * 2).alias("doubled"), F.col("slot_no"))


@query("SELECT tx_id, tx_ix, address, NULL::VARCHAR AS datum_hash FROM utxo WHERE address IN (1, 2, 3)", "utxo")
def utxo_tracked_addresses(spark, sf):
    return preprocess.without_scripts(preprocess.tracked_addresses(fx.utxo(spark, sf), [1, 2, 3]), "datum_hash").select("tx_id", "tx_ix", "address", "datum_hash")


@query("SELECT address, count(*) AS n_outputs, sum(value) AS value FROM utxo GROUP BY 1", "utxo")
def utxo_balance(spark, sf):
    return fx.utxo(spark, sf).groupBy("address").agg(F.count("*").alias("n_outputs"), F.sum("value").alias("value"))


@query(f"SELECT tx_id, tx_ix, spent_at_tx FROM spent WHERE slot_no = {SLOT}", "spent")
def spent_at_slot(spark, sf):
    return generic.event_at(fx.spent(spark, sf), SLOT).select("tx_id", "tx_ix", "spent_at_tx")


@query(f"SELECT slot_no, tx_id, tx_ix, spent_at_tx FROM spent WHERE slot_no <= {SLOT}", "spent")
def spent_matching(spark, sf):
    return generic.events_matching(fx.spent(spark, sf), SLOT).select("slot_no", "tx_id", "tx_ix", "spent_at_tx")


@query("SELECT tx_id, tx_ix, min(slot_no) AS slot_no FROM (SELECT * FROM spent UNION ALL SELECT tx_id, tx_ix, spent_at_tx + 1, slot_no + 1 FROM spent) GROUP BY 1, 2", "spent")
def spent_dedup(spark, sf):
    spent = fx.spent(spark, sf)
    again = spent.withColumns({"spent_at_tx": F.col("spent_at_tx") + 1, "slot_no": F.col("slot_no") + 1})
    return domain.spent_once(spent.unionByName(again)).select("tx_id", "tx_ix", "slot_no")


@query("SELECT spent_at_tx, count(*) AS n_inputs, string_agg(tx_id || '#' || tx_ix, ',' ORDER BY tx_id, tx_ix) AS inputs FROM spent GROUP BY 1", "spent")
def spends_by_transaction(spark, sf):
    rows = fx.spent(spark, sf).groupBy("spent_at_tx").agg(F.count("*").alias("n_inputs"), F.sort_array(F.collect_list(F.struct("tx_id", "tx_ix"))).alias("refs"))
    return rows.select("spent_at_tx", "n_inputs", render.references("refs").alias("inputs"))


# --- data


@query(f"SELECT datum_hash, datum FROM datum WHERE slot_no = {EARLY}", "datum")
def datum_at_slot(spark, sf):
    return generic.event_at(fx.datum(spark, sf), EARLY).select("datum_hash", "datum")


@query(f"SELECT slot_no, datum_hash, datum FROM datum WHERE slot_no <= {SLOT}", "datum")
def datum_matching(spark, sf):
    return generic.events_matching(fx.datum(spark, sf), SLOT).select("slot_no", "datum_hash", "datum")


@query("SELECT datum_hash, datum, slot_no FROM datum WHERE datum_hash = md5('7')", "datum")
def datum_resolve(spark, sf):
    import hashlib

    return domain.resolve_datum(fx.datum(spark, sf), hashlib.md5(b"7").hexdigest()).select("datum_hash", "datum", "slot_no")


@query("SELECT datum_hash, min(slot_no) AS slot_no FROM utxo WHERE datum_hash IS NOT NULL GROUP BY 1", "utxo")
def datum_first_seen(spark, sf):
    return preprocess.first_sighting(fx.utxo(spark, sf).select("datum_hash", "slot_no"), "datum_hash").select("datum_hash", "slot_no")


# --- blocks


@query(f"SELECT block_no, block_timestamp, epoch_no FROM block_info WHERE slot_no = {SLOT}", "block_info")
def block_info_by_slot(spark, sf):
    return generic.event_at(fx.block_info(spark, sf), SLOT).select("block_no", "block_timestamp", "epoch_no")


@query(f"SELECT slot_no, block_no, epoch_no FROM block_info WHERE slot_no <= {SLOT} ORDER BY slot_no DESC LIMIT 5", "block_info")
def block_info_latest_n(spark, sf):
    return generic.latest_events(fx.block_info(spark, sf), 5, SLOT).select("slot_no", "block_no", "epoch_no")


@query(f"SELECT slot_no, block_no FROM block_info WHERE slot_no <= {SLOT} AND epoch_no % 2 = 0", "block_info")
def block_info_matching(spark, sf):
    return generic.events_matching(fx.block_info(spark, sf), SLOT, F.col("epoch_no") % 2 == 0).select("slot_no", "block_no")


@query(f"SELECT slot_no, block_no FROM block_info WHERE slot_no <= {SLOT} AND block_no = 700", "block_info")
def block_by_number(spark, sf):
    return generic.events_matching(fx.block_info(spark, sf), SLOT, F.col("block_no") == 700).select("slot_no", "block_no")


@query(
    f"SELECT b.slot_no, b.block_no, b.epoch_no, b.block_timestamp, t.tip_slot, t.tip_block_no FROM (SELECT * FROM block_info WHERE slot_no <= (SELECT least(max(u.slot_no), {SLOT}) FROM utxo u) ORDER BY slot_no DESC LIMIT 1) b, (SELECT max(slot_no) AS tip_slot, max(block_no) AS tip_block_no FROM block_info) t",
    "block_info", "utxo",
)
def current_sync_point(spark, sf):
    blocks = fx.block_info(spark, sf)
    synced = fx.utxo(spark, sf).agg(F.max("slot_no")).first()[0]
    tip = blocks.agg(F.max("slot_no").alias("tip_slot"), F.max("block_no").alias("tip_block_no"))
    return domain.sync_point(blocks, tip, min(synced, SLOT) if synced is not None else None)


# --- assets


@query("SELECT slot_no, policy_id, asset_name, quantity FROM mint", "mint")
def mint_all(spark, sf):
    return domain.by_sign(fx.mint(spark, sf), None).select("slot_no", "policy_id", "asset_name", "quantity")


@query("SELECT slot_no, policy_id, asset_name, quantity FROM mint WHERE quantity > 0", "mint")
def mint_only(spark, sf):
    return domain.by_sign(fx.mint(spark, sf), "mint").select("slot_no", "policy_id", "asset_name", "quantity")


@query("SELECT slot_no, policy_id, asset_name, quantity FROM mint WHERE quantity < 0", "mint")
def burn_only(spark, sf):
    return domain.by_sign(fx.mint(spark, sf), "burn").select("slot_no", "policy_id", "asset_name", "quantity")


@query("SELECT slot_no, policy_id, asset_name, quantity FROM mint WHERE policy_id = 3 OR (policy_id = 5 AND asset_name = 'error')", "mint")
def mint_by_assets(spark, sf):
    return preprocess.tracked_assets(fx.mint(spark, sf), [(3, None), (5, "error")]).select("slot_no", "policy_id", "asset_name", "quantity")


@query(f"SELECT slot_no, block_no, tx_index, abs(quantity) AS burn_amount FROM mint WHERE policy_id = {POLICY} AND quantity < 0 AND slot_no <= {AT} AND slot_no >= (SELECT min(slot_no) FROM mint WHERE policy_id = {POLICY})", "mint")
def burn_by_policy_bounds(spark, sf):
    rows = fx.mint(spark, sf)
    # without an event by then there is no first one to start from, and no row
    first = generic.until(rows, AT).where(F.col("policy_id") == POLICY).agg(F.min("tx_id")).first()[0]
    out = domain.asset_events(rows, POLICY, None, "burn", AT, first, AT)
    return out.select("slot_no", "block_no", "tx_index", F.abs("quantity").alias("burn_amount"))


@query(f"SELECT slot_no, abs(quantity) AS burn_amount, block_no <= {AT} - {DEPTH} AS is_stable FROM mint WHERE policy_id = {POLICY} AND quantity < 0 AND slot_no <= {AT}", "mint")
def burn_with_depth_stability(spark, sf):
    out = domain.asset_events(fx.mint(spark, sf), POLICY, None, "burn", AT, None, AT)
    out = domain.with_depth_stability(out, fx.blocks(spark, sf), AT, DEPTH)
    return out.select("slot_no", F.abs("quantity").alias("burn_amount"), "is_stable")


@query(f"SELECT slot_no, abs(quantity) AS burn_amount, slot_no <= (SELECT max(block_no) - {DEPTH} - 1 FROM blocks) AS is_stable FROM mint WHERE policy_id = 3 AND quantity < 0", "mint", "blocks")
def burn_with_stability(spark, sf):
    blocks = fx.blocks(spark, sf)
    stable = changelog.stable_point(blocks.withColumn("tip_block_no", F.col("block_no")), DEPTH).first()[0]
    out = changelog.with_stability(domain.asset_events(fx.mint(spark, sf), 3, None, "burn"), stable)
    return out.select("slot_no", F.abs("quantity").alias("burn_amount"), "is_stable")


@query("SELECT slot_no, '{' || string_agg('\"' || asset_name || '\":' || q, ',' ORDER BY asset_name) || '}' AS value FROM (SELECT policy_id AS slot_no, asset_name, CAST(sum(quantity) AS BIGINT) AS q FROM mint GROUP BY 1, 2) GROUP BY 1", "mint")
def value_map_json(spark, sf):
    sums = fx.mint(spark, sf).groupBy(F.col("policy_id").alias("slot_no"), "asset_name").agg(F.sum("quantity").alias("q"))
    return sums.groupBy("slot_no").agg(F.sort_array(F.collect_list(F.struct("asset_name", "q"))).alias("assets")).select("slot_no", render.asset_json("assets").alias("value"))


# --- epochs and addresses


@query("SELECT epoch_no, pool_id, lovelace FROM sdd WHERE epoch_no = 100 - 2", "sdd")
def epoch_sdd_active(spark, sf):
    return domain.active_stake(fx.sdd(spark, sf), 100).select("epoch_no", "pool_id", "lovelace")


@query("SELECT epoch_no, md5(epoch_no::VARCHAR) AS nonce, slot_no FROM (SELECT epoch_no, min(slot_no) AS slot_no FROM block_info GROUP BY 1) WHERE epoch_no = 100", "block_info")
def epoch_nonce_by_epoch(spark, sf):
    first = fx.block_info(spark, sf).groupBy("epoch_no").agg(F.min("slot_no").alias("slot_no"))
    nonces = first.withColumn("nonce", F.md5(F.col("epoch_no").cast("string").cast("binary")))
    return domain.nonce_of(nonces, 100).select("epoch_no", "nonce", "slot_no")


@query("SELECT o_custkey % 20 AS pool_id, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS lovelace FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY 1")
def stake_by_pool(spark, sf):
    from tidemark.operators import extract

    delegations = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("credential")).distinct().withColumn("pool_id", F.col("credential") % 20)
    stake = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("credential"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("lovelace"))
    return extract.stake_by_pool(delegations, stake)


@query(f"SELECT coalesce(CAST(sum(count) AS BIGINT), 0) AS count FROM address_counts WHERE address = {ADDRESS} AND slot_no <= {SLOT}", "address_counts")
def address_count_asof(spark, sf):
    return domain.address_count(fx.address_counts(spark, sf), F.lit(ADDRESS), SLOT)


@query("SELECT address, slot_no, count FROM address_counts", "address_counts")
def address_counts_by_block(spark, sf):
    return fx.address_counts(spark, sf)


# --- any event


@query(f"SELECT slot_no, user_id, event_type FROM blocks WHERE slot_no = {AT}", "blocks")
def event_at(spark, sf):
    return generic.event_at(fx.blocks(spark, sf), AT).select("slot_no", "user_id", "event_type")


@query(f"SELECT slot_no, user_id + 1 AS mapped FROM blocks WHERE slot_no <= {AT} AND event_type = 'click'", "blocks")
def events_matching(spark, sf):
    return generic.events_matching(fx.blocks(spark, sf), AT, F.col("event_type") == "click", F.col("slot_no"), (F.col("user_id") + 1).alias("mapped"))


@query("SELECT slot_no, block_hash, block_no, epoch_no, ts, user_id, event_type FROM blocks", "blocks")
def all_events(spark, sf):
    return generic.events_matching(fx.blocks(spark, sf), None)


@query(f"SELECT slot_no, event_type FROM blocks WHERE slot_no <= {AT} ORDER BY slot_no DESC LIMIT 20", "blocks")
def latest_events(spark, sf):
    return generic.latest_events(fx.blocks(spark, sf), 20, AT).select("slot_no", "event_type")


@query(f"SELECT slot_no, event_type FROM blocks WHERE slot_no > 300 AND slot_no <= {AT}", "blocks")
def events_from(spark, sf):
    return generic.events_from(fx.blocks(spark, sf), 300, AT).select("slot_no", "event_type")


@query("SELECT slot_no, user_id, event_type FROM blocks ORDER BY slot_no DESC LIMIT 1", "blocks")
def last_event(spark, sf):
    return generic.last_event(fx.blocks(spark, sf), "user_id", "event_type")


@query("SELECT slot_no, event_type FROM blocks", "blocks")
def events_hot_cold_union(spark, sf):
    return generic.appended(*generic.hot_and_cold(fx.blocks(spark, sf), AT)).select("slot_no", "event_type")


@query(f"SELECT slot_no, slot_no <= {AT} AS is_stable FROM blocks", "blocks")
def events_with_stability(spark, sf):
    return changelog.with_stability(fx.blocks(spark, sf), AT).select("slot_no", "is_stable")


@query("SELECT slot_no, string_agg(tx_id || '#' || tx_ix, ',' ORDER BY tx_id, tx_ix) AS events FROM utxo GROUP BY 1", "utxo")
def regroup_by_point(spark, sf):
    return generic.regrouped(fx.utxo(spark, sf), "tx_id", "tx_ix").select("slot_no", render.references("events").alias("events"))


# --- the change log


@query("SELECT seq, slot_no FROM valid", "valid")
def log_valid_rows(spark, sf):
    return changelog.valid_rows(fx.log(spark, sf)).select("seq", "slot_no")


@query(f"SELECT seq, slot_no FROM valid WHERE slot_no <= {AT}", "valid")
def log_valid_asof(spark, sf):
    return generic.until(changelog.valid_rows(fx.log(spark, sf)), AT).select("seq", "slot_no")


@query("SELECT seq, slot_no FROM log l WHERE op = 'INDEX' AND seq <= 1000 AND NOT EXISTS (SELECT 1 FROM log r WHERE r.op = 'ROLLBACK' AND r.seq <= 1000 AND r.seq > l.seq AND r.to_slot < l.slot_no)", "log")
def log_as_known_at(spark, sf):
    return changelog.valid_rows(changelog.as_known_at(fx.log(spark, sf), 1000)).select("seq", "slot_no")


@query(f"SELECT max(slot_no) AS stable_slot FROM valid WHERE block_no < (SELECT max(block_no) FROM valid) - {DEPTH}", "valid")
def log_stable_point(spark, sf):
    valid = changelog.valid_rows(fx.log(spark, sf)).withColumn("tip_block_no", F.col("block_no"))
    return changelog.stable_point(valid, DEPTH)


@query(f"SELECT slot_no, slot_no <= (SELECT max(slot_no) FROM valid WHERE block_no < (SELECT max(block_no) FROM valid) - {DEPTH}) AS is_stable FROM valid", "valid")
def log_with_stability(spark, sf):
    valid = changelog.valid_rows(fx.log(spark, sf)).withColumn("tip_block_no", F.col("block_no"))
    edge = F.broadcast(changelog.stable_point(valid, DEPTH))  # one row
    return changelog.with_stability(valid.crossJoin(edge), F.col("stable_slot")).select("slot_no", "is_stable")


@query(f"SELECT seq, op FROM log WHERE (op = 'INDEX' AND slot_no > {AT}) OR (op = 'ROLLBACK' AND to_slot > {AT})", "log")
def log_resume_filter(spark, sf):
    return changelog.resumed(fx.log(spark, sf), AT).select("seq", "op")


@query("SELECT slot_no, (SELECT max(block_no) FROM blocks) - block_no AS distance FROM blocks", "blocks")
def distance_to_tip(spark, sf):
    blocks = fx.blocks(spark, sf)
    tip = F.broadcast(blocks.agg(F.max("block_no").alias("tip_block_no")))  # one row
    return changelog.distance(blocks.crossJoin(tip)).select("slot_no", "distance")


@query("SELECT count(*) FILTER (op = 'INDEX') AS blocks, count(*) FILTER (op = 'ROLLBACK') AS rollbacks, max(slot_no) AS sync_slot FROM log", "log")
def sync_stats(spark, sf):
    is_ = lambda op: F.sum((F.col("op") == op).cast("bigint"))
    return fx.log(spark, sf).agg(is_("INDEX").alias("blocks"), is_("ROLLBACK").alias("rollbacks"), F.max("slot_no").alias("sync_slot"))


# --- state over the order


@query("SELECT slot_no, epoch_no FROM (SELECT *, lag(epoch_no) OVER (ORDER BY slot_no) AS p FROM blocks) WHERE p IS NULL OR p <> epoch_no", "blocks")
def first_of_epoch(spark, sf):
    return preprocess.first_of_epoch(fx.blocks(spark, sf)).select("slot_no", "epoch_no")


@query("SELECT slot_no, CAST(sum(user_id) OVER (ORDER BY slot_no) AS BIGINT) AS total FROM blocks", "blocks")
def running_fold(spark, sf):
    return preprocess.running_fold(fx.blocks(spark, sf), F.col("user_id")).select("slot_no", "total")


@query(f"SELECT slot_no, event_type FROM blocks WHERE slot_no < (SELECT min(slot_no) FROM (SELECT slot_no FROM blocks ORDER BY slot_no DESC LIMIT {DEPTH}))", "blocks")
def delayed_events(spark, sf):
    return preprocess.delayed(fx.blocks(spark, sf), DEPTH).select("slot_no", "event_type")


@query("SELECT user_id, slot_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot_no DESC) AS r FROM blocks) WHERE r <= 2", "blocks")
def keep_last_n(spark, sf):
    return preprocess.keep_last(fx.blocks(spark, sf), 2, "user_id").select("user_id", "slot_no")


@query("SELECT slot_no, block_no FROM blocks WHERE block_no BETWEEN 100 AND 200", "blocks")
def block_range(spark, sf):
    return preprocess.in_block_range(fx.blocks(spark, sf), 100, 200).select("slot_no", "block_no")


@query("SELECT slot_no, block_no FROM blocks WHERE block_no = 99", "blocks")
def just_before_range(spark, sf):
    return preprocess.just_before_range(fx.blocks(spark, sf), 100).select("slot_no", "block_no")


@query(f"SELECT slot_no, event_type FROM blocks WHERE slot_no > {AT}", "blocks")
def pruned_view(spark, sf):
    return preprocess.pruned(fx.blocks(spark, sf), AT).select("slot_no", "event_type")
