"""Ingest: a stream of change-log rows becomes tables that are read at a position.

One streaming query feeds all tables. What a rollback may still take back is hot: each batch appends a segment of its valid
rows, and one small list has the positions that are valid now. Every `flush_every` batches, or when a batch brings many
blocks, the hot rows that have become final are written as a run of the cold store, the rest as one new segment; rows that
lost are simply not written again. Cold runs hold ranges of slots; `merge` runs of a level become one of the next, laid out
for lookups. So the files stay few however long the chain is, and cold rows are read as they are.

All tables of a batch are written first; one row of state that names segments and runs comes last and is written in turn to
two places. What no state names does not exist for readers. So several tables move in lock-step, a failure leaves none of
them ahead, and a batch that runs again overwrites its own.

Order of arrival is (incarnation, batch, seq). Opening the tables again starts an incarnation: hot rows that are not final
are dropped, and a source may send the same rows with the same numbers once more.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.errors import NotStoredAnymore, StopIngest
from tidemark.operators import changelog, extract, generic
from tidemark.operators.preprocess import check_pruned, first_sighting, tracked_addresses, tracked_assets, without_scripts
from tidemark.plans.domain import spent_once
from tidemark.sources import chain, files
from tidemark.sources.shared import released
from tidemark.streaming import layout
from tidemark.streaming.commits import Commits
from tidemark.streaming.stats import SyncStats


@dataclasses.dataclass(frozen=True)
class Table:
    """A table of the index: its schema, how rows come out of blocks (they keep slot_no, block_hash and seq), and what makes
    one row of several valid ones when the table is read.

    `key` is what lookups go by, beside the slot. `folded` may make fewer rows of final ones for good, with the same result
    when they are read. With `per_epoch`, rows show once their epoch is over for good."""

    name: str
    schema: str
    rows: Callable[[DataFrame], DataFrame]
    reduced: Callable[[DataFrame], DataFrame] = lambda rows: rows
    key: str = "slot_no"
    folded: Callable[[DataFrame], DataFrame] | None = None
    per_epoch: bool = False


TABLES = (
    Table("block_info", schemas.BLOCK_INFO, extract.block_info),
    Table("utxo", schemas.UTXO, lambda b: extract.outputs(extract.transactions(b, *extract.OUTPUTS)), key="address"),
    Table("spent", schemas.SPENT, lambda b: extract.inputs(extract.transactions(b, *extract.INPUTS)), spent_once, "tx_id"),
    Table("datum", schemas.DATUM, lambda b: extract.datums(extract.transactions(b, *extract.DATUMS)), lambda rows: first_sighting(rows, "datum_hash", "datum"), "datum_hash"),
    Table("mint", schemas.MINT, lambda b: extract.mints(extract.transactions(b, *extract.MINTS)), key="policy_id"),
)


def epoch_tables(pool: str, ada: str) -> tuple[Table, ...]:
    """Stake per epoch and pool, and the nonce of each epoch, from the blocks themselves.

    Each block adds its part to its epoch; parts of final blocks are folded, so the state has a row per pool and epoch. An
    epoch shows when a final block lies beyond it. `pool` and `ada` are SQL over an output `o`; the nonce is the hash of
    the first block."""
    stake = lambda rows, *more: rows.groupBy("epoch_no", "pool_id", *more)
    newest = lambda c: F.max_by(c, "slot_no").alias(c)

    def parts(blocks: DataFrame) -> DataFrame:
        outs = blocks.select("seq", "slot_no", "block_hash", "block_no", "epoch_no", F.explode(F.arrays_zip("txs.script_valid", "txs.outputs")).alias("tx"))
        outs = outs.select("*", F.explode("tx.outputs").alias("o")).where("tx.script_valid")
        sums = stake(outs.select("*", F.expr(pool).alias("pool_id"), F.expr(ada).alias("ada")), "seq", "slot_no", "block_hash", "block_no")
        return sums.agg(F.sum("ada").cast("decimal(38,0)").alias("lovelace"))

    def summed(rows: DataFrame) -> DataFrame:
        sums = stake(rows).agg(F.sum("lovelace").cast("decimal(38,0)").alias("lovelace"), newest("block_no"), newest("block_hash"), F.max("slot_no").alias("last"))
        return sums.withColumnRenamed("last", "slot_no")

    def first(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "epoch_no"]
        return rows.groupBy("epoch_no").agg(F.min_by(F.struct(*rest), "slot_no").alias("f")).select("epoch_no", "f.*")

    nonce = lambda blocks: extract.heads(blocks).select("seq", "epoch_no", F.sha2("block_hash", 256).alias("nonce"), "block_no", "slot_no", "block_hash")
    return (
        Table("epoch_sdd", schemas.EPOCH_SDD, parts, summed, "epoch_no", summed, True),
        Table("epoch_nonce", schemas.EPOCH_NONCE, nonce, first, "epoch_no", first, True),
    )


def configured(addresses: Sequence[str] = (), assets: Sequence[tuple] = (), scripts: bool = True) -> tuple[Table, ...]:
    """The tables with only the tracked addresses and assets (none listed: all), and with or without scripts."""

    def outputs(blocks: DataFrame) -> DataFrame:
        rows = tracked_addresses(extract.outputs(extract.transactions(blocks, *extract.OUTPUTS)), list(addresses))
        return rows if scripts else without_scripts(rows, "script", "script_hash")

    def mints(blocks: DataFrame) -> DataFrame:
        rows = extract.mints(extract.transactions(blocks, *extract.MINTS))
        return tracked_assets(rows, list(assets)) if assets else rows

    own = {"utxo": outputs, "mint": mints}
    return tuple(dataclasses.replace(t, rows=own.get(t.name, t.rows)) for t in TABLES)


#: Rows of a batch that are kept in memory; more are written down once, and each table reads the columns that it needs.
IN_MEMORY = 200_000
#: Files of a merged run: with more rows files become larger, up to so many rows a file.
RUN_FILES, FILE_ROWS = 512, 1_000_000
#: A merged run of more rows is dealt by stretches, so that its shuffle never has all of it on disk.
AT_ONCE = 1_000_000

_LIVE = "batch bigint, seq bigint, slot_no bigint, block_no bigint, tip_block_no bigint, epoch_no bigint"
#: The positions of the blocks are a table like the others.
_POSITIONS = Table("_positions", "slot_no bigint, block_no bigint, tip_block_no bigint, epoch_no bigint, arrival bigint", lambda b: extract.heads(b).select("slot_no", "block_no", "tip_block_no", "epoch_no", F.col("seq").alias("arrival"), "seq"))


@dataclasses.dataclass
class Settings:
    """Read again at every batch, so it can be changed while the stream runs.

    `actions` get the blocks of each batch, in as many rows as they came in, once its tables are committed, and again if the driver was lost before they were
    done. `prune_every` prunes to the stable point whenever it has moved on by so many slots. Hot rows are flushed every
    `flush_every` batches and by batches of `flush_blocks` blocks; `merge` cold runs become one, in files of `file_rows`, or larger ones if they are over
    RUN_FILES."""

    depth: int = 2160
    on_caught_up: Callable[[int], None] | None = None
    caught_up_distance: int = 100
    caught_up: bool = False
    actions: tuple[Callable[[DataFrame], None], ...] = ()
    prune_every: int | None = None
    stats: SyncStats | None = None
    flush_every: int = 8
    flush_blocks: int = 10_000
    merge: int = 8
    file_rows: int = 1_000_000


@dataclasses.dataclass
class Run:
    """A folder with final rows of all tables, of slots low..high; from level 1 on it is laid out for lookups."""

    name: str
    low: int
    high: int
    level: int = 0


@dataclasses.dataclass
class State:
    """What the last commit says: its number, the last batch of each source, the positions, and where the rows are."""

    batch: int = -1
    incarnation: int = 0
    sources: dict[str, int] = dataclasses.field(default_factory=dict)
    last: int | None = None
    stable: int | None = None
    epoch: int | None = None
    pruned: int | None = None
    newest: int = -1  # the largest seq so far, and that of the incarnations before
    replayed: int = -1
    acted: int = -1
    hot: list[str] = dataclasses.field(default_factory=list)
    cold: list[Run] = dataclasses.field(default_factory=list)
    gone: list[str] = dataclasses.field(default_factory=list)

    @staticmethod
    def read(text: str) -> State:
        known = json.loads(text)
        return State(**known | {"cold": [Run(**r) for r in known["cold"]]})


class Ingest:
    """Writes and reads the tables below one folder. One writer at a time; it keeps its state between batches."""

    def __init__(self, spark: SparkSession, root: str, tables: Sequence[Table] = TABLES, settings: Settings | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tuple(tables)
        self.settings = settings or Settings()
        self._state: State | None = None
        self._commits = Commits(spark, f"{self.root}/_state")

    # --- writing

    def process(self, batch: DataFrame, batch_id: int, source: str = "", stored: bool = False) -> None:
        """The body of foreachBatch: rows of (seq, op, to_slot, block); batch ids ascend within a source. A batch that is `stored`
        is read from files that stay, column by column; it need not be written down."""
        state = self._state = self._state or self.state()
        if batch_id <= state.sources.get(source, -1):  # a restart runs the last batch again
            if self.settings.actions and batch_id == state.sources[source] and state.acted < state.batch:
                self._act(batch.where("op = 'INDEX'").select("seq", "block.*"))
            return
        if batch.limit(IN_MEMORY + 1).count() > IN_MEMORY:
            if stored:
                return self._process(state, batch, batch_id, source)
            written = f"{self.root}/_batch"
            try:
                batch.write.options(**files.CODEC).mode("overwrite").parquet(written)
                self._process(state, self.spark.read.schema(batch.schema).parquet(written), batch_id, source)
            finally:
                files.remove(self.spark, written)
            return
        batch = batch.persist()
        try:
            self._process(state, batch, batch_id, source)
        finally:
            batch.unpersist()

    def _process(self, old: State, batch: DataFrame, batch_id: int, source: str, flush: bool = False, reopened: bool = False) -> None:
        s = self.settings
        # what is final comes again when a source starts anew; its rollbacks of then go no further than that
        again = F.col("seq") <= F.lit(old.replayed)
        if old.stable is not None:
            batch = batch.where((F.col("op") != "INDEX") | (F.col("block.slot_no") > old.stable)).withColumn("to_slot", F.when(again, F.greatest(F.coalesce("to_slot", F.lit(-1)), F.lit(old.stable))).otherwise(F.col("to_slot")))
        is_ = lambda op: F.count_if(F.col("op") == op)
        back = F.min(F.when(F.col("op") == "ROLLBACK", F.coalesce("to_slot", F.lit(-1))))
        seen = batch.agg(is_("STOP").alias("stops"), extract.count_heads().alias("blocks"), is_("ROLLBACK").alias("rollbacks"), back.alias("back"), F.max("seq").alias("last"), F.count("*").alias("rows")).first()
        if seen.stops:
            raise StopIngest("the source asked to stop")
        if seen.rollbacks:
            changelog.check_target(seen.back, old.stable)
            check_pruned(old.pruned, seen.back)
        new = dataclasses.replace(old, batch=old.batch + 1, sources=old.sources | {source: batch_id}, newest=max(old.newest, -1 if seen.last is None else seen.last))
        if reopened:
            new = dataclasses.replace(new, incarnation=old.incarnation + 1, newest=old.newest, replayed=old.newest)
        flat = batch.where("op = 'INDEX'").select("seq", "block.*")
        own = extract.heads(flat).select(F.lit(new.batch).cast("bigint").alias("batch"), "seq", "slot_no", "block_no", "tip_block_no", "epoch_no")
        judged = changelog.after_batch(self._live(old), own, batch, seen.rollbacks, seen.blocks)
        judged = judged.select(*_names(_LIVE), "valid").persist()
        try:
            valid = judged.where("valid").drop("valid")
            lost = judged.where(~F.col("valid") & (F.col("batch") == new.batch)).select("seq")
            at = valid.agg(F.min("slot_no").alias("first"), F.max("slot_no").alias("last"), F.max("tip_block_no").alias("tip"), F.max("block_no").alias("block_no")).first()
            edge = valid.where(F.col("block_no") < _number(None if at.tip is None else at.tip - s.depth)).agg(F.max("slot_no").alias("slot"), F.max_by("epoch_no", "slot_no").alias("epoch")).first()
            new.last = at.last if at.last is not None else old.stable
            if edge.slot is not None and (old.stable is None or edge.slot >= old.stable):
                new.stable, new.epoch = edge.slot, edge.epoch
            large = seen.blocks >= s.flush_blocks or seen.rows > IN_MEMORY
            flush = flush or len(old.hot) + 1 >= s.flush_every or seen.blocks >= s.flush_blocks
            name, final = f"{new.batch:012d}", F.coalesce(F.col("slot_no") <= _number(new.stable), F.lit(False))
            few = seen.rollbacks and lost.limit(1_000_001).count() <= 1_000_000  # 8 MB of numbers
            kept = flat.join(F.broadcast(lost) if few else lost, "seq", "left_anti") if seen.rollbacks else flat

            def rows(t: Table) -> DataFrame:
                out = t.rows(kept).select(*_names(t.schema), "seq", F.lit(new.batch).cast("bigint").alias("batch"))
                if not flush:
                    return out.withColumn("final", F.lit(False))
                # what is flushed has few files; what lost is left behind
                out = out.unionByName(self._hot(t, old, valid)).withColumn("final", final)
                if t.folded is not None:
                    done = t.folded(out.where("final").drop("seq", "batch", "final")).withColumns({"seq": F.lit(None).cast("bigint"), "batch": F.lit(None).cast("bigint"), "final": F.lit(True)})
                    out = out.where("not final").unionByName(done.select(out.columns))
                return out if large else out.hint("rebalance")

            work = [lambda t=t: rows(t).write.options(**files.CODEC).mode("overwrite").partitionBy("final").parquet(f"{self.root}/{t.name}/segment={name}") for t in (*self.tables, _POSITIONS)]
            # the stable position itself stays: it is where a rollback may go back to
            live = valid if not flush or new.stable is None else valid.where(F.col("slot_no") >= new.stable)
            work.append(lambda: live.repartition(1).write.mode("overwrite").parquet(f"{self.root}/_live/{name}"))
            _together(work, self.spark, batch.sparkSession)
            gone = [f"_live/{h}" for h in old.hot[-1:]]
            if flush:
                gone += [f"{t.name}/segment={h}/final=false" for h in old.hot for t in (*self.tables, _POSITIONS)]
                new.hot = [name]
                if new.stable is not None and (not new.cold or new.stable > new.cold[-1].high):
                    new.cold = [*new.cold, Run(name, new.cold[-1].high + 1 if new.cold else at.first, new.stable)]
                gone += self._merge(new)
            else:
                new.hot = [*old.hot, name]
            self._commit(new, gone)
            self._after(flat, at, seen)
        finally:
            judged.unpersist()

    def _merge(self, state: State) -> list[str]:
        """Makes one run of the newest `merge` ones of a level, again and again; what can go then."""
        gone: list[str] = []
        while len(last := state.cold[-self.settings.merge :]) == self.settings.merge and len({r.level for r in last}) == 1:
            run = Run(f"{state.batch:012d}-{last[0].level + 1}", last[0].low, last[-1].high, last[0].level + 1)
            _together([lambda t=t: self._lay(t, state, last, run) for t in (*self.tables, _POSITIONS)], self.spark)
            state.cold = [*state.cold[: -len(last)], run]
            gone += self._paths(last)
        return gone

    def _paths(self, runs: list[Run]) -> list[str]:
        names = [t.name for t in (*self.tables, _POSITIONS)]
        return [x for r in runs for n in names for x in (f"{n}/segment={r.name}/final=true", *((f"{kind}/{n}/{r.name}" for kind in ("_zones", "_blooms")) if r.level else ()))]

    def _lay(self, t: Table, state: State, runs: list[Run], run: Run) -> None:
        rows = self._cold(t, dataclasses.replace(state, cold=runs))
        rows = rows if t.folded is None else t.folded(rows).select(*_names(t.schema))
        many = rows.count()
        each = max(self.settings.file_rows, min(FILE_ROWS, -(-many // RUN_FILES)))
        where, mode = f"{self.root}/{t.name}/segment={run.name}", "overwrite"
        for some, own in layout.stretches(rows, t.key) if many > AT_ONCE else [(rows, many)]:
            laid = layout.laid_out(some, t.key, max(1, -(-own // each)), run.low, run.high)
            laid.withColumns({"seq": F.lit(None).cast("bigint"), "batch": F.lit(None).cast("bigint"), "final": F.lit(True)}).write.options(**files.CODEC).mode(mode).partitionBy("final").parquet(where)
            mode = "append"
        written = self._parquet(t, [run.name])
        zones = layout.zones(written, t.key)
        zones.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_zones/{t.name}/{run.name}")
        if "tx_id" in _names(t.schema):
            most = self.spark.read.schema(_ZONES).parquet(f"{self.root}/_zones/{t.name}/{run.name}").agg(F.max("rows")).first()[0]
            layout.blooms(written, "tx_id", most or 1).write.mode("overwrite").parquet(f"{self.root}/_blooms/{t.name}/{run.name}")

    def _commit(self, state: State, gone: Sequence[str] | None = None) -> None:
        """What the state does not name any more is `gone`; it is removed by the next commit that has such, when those who read
        the state before are done."""
        before: list[str] = []
        if gone is not None:
            before, state.gone = state.gone, list(gone)
        self._commits.write(json.dumps(dataclasses.asdict(state)))
        self._state = state
        for path in before:
            files.remove(self.spark, f"{self.root}/{path}")

    def _after(self, flat: DataFrame, at, seen) -> None:
        s, state = self.settings, self._state
        if s.stats is not None:
            s.stats.seen(seen.blocks, seen.rollbacks, at.block_no, at.tip)
        if s.on_caught_up and not s.caught_up and at.last is not None:
            near = changelog.distance(self._live(state)).agg(F.min("distance")).first()[0]
            if near is not None and near <= s.caught_up_distance:
                s.caught_up = True
                s.on_caught_up(state.last)
        if s.actions:
            self._act(flat)
        if s.prune_every is not None and state.stable is not None and state.stable - (state.pruned or 0) >= s.prune_every:
            self.prune(state.stable)

    def _act(self, blocks: DataFrame) -> None:
        for action in self.settings.actions:
            action(blocks)
        self._commit(dataclasses.replace(self._state, acted=self._state.batch))

    def start(self, log: DataFrame, checkpoint: str, available_now: bool = True):
        """Runs a stream into the tables. A new checkpoint is a new source: its batches come after those that are there."""
        source = checkpoint.rstrip("/")
        writer = log.writeStream.foreachBatch(lambda batch, i: self.process(batch, i, source)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def start_files(self, names: DataFrame, folder: str, checkpoint: str):
        """The same for a stream of the names of a log's files (chain.stream_names), up to those that are there now."""
        source = checkpoint.rstrip("/")

        def read(batch: DataFrame, i: int) -> None:
            found = sorted(r.file_name for r in batch.distinct().collect())  # as many as a batch has files
            rows = chain.read_log(self.spark, *(f"{folder}/{n}" for n in found)) if found else self.spark.createDataFrame([], schemas.STREAM)
            self.process(rows, i, source, stored=True)

        return names.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def reopen(self) -> int | None:
        """Goes back to the last stable position and returns it; what came after may lie on a fork that is gone. The source
        starts anew, from there or from its beginning, with the same numbers or with others: what is final is passed over."""
        state = self._state = self.state()
        if state.batch >= 0:
            back = self.spark.createDataFrame([(state.newest + 1, "ROLLBACK", state.stable, None)], schemas.STREAM)
            self._process(state, back, state.sources.get("reopen", -1) + 1, "reopen", flush=True, reopened=True)
        return state.stable

    def reset(self) -> None:
        """Back to genesis: all tables are empty, whatever was final; what a source sends next starts anew."""
        files.remove(self.spark, self.root)
        self._state, self._commits.number = None, None

    def prune(self, slot: int) -> None:
        """Forgets all up to a final slot. Runs that lie behind it as a whole go; of others the rows no longer show, and the next
        merge leaves them out."""
        state = self._state = self._state or self.state()
        if state.stable is None or slot > state.stable:
            raise ValueError(f"slot {slot} is not final yet")
        if state.pruned is not None and slot <= state.pruned:
            return
        behind = [r for r in state.cold if r.high <= slot]
        self._commit(dataclasses.replace(state, pruned=slot, cold=[r for r in state.cold if r.high > slot]), self._paths(behind))

    # --- reading

    def state(self) -> State:
        """The state that the newest commit tells."""
        text = self._commits.read()
        return State.read(text) if text else State()

    def progress(self) -> DataFrame:
        """A row per table: they move together."""
        state = self.state()
        rows = [(state.batch, t.name, state.last, state.stable, state.pruned) for t in self.tables] if state.batch >= 0 else []
        return self.spark.createDataFrame(rows, schemas.PROGRESS)

    def point(self) -> tuple[int | None, int | None]:
        """The position at which all tables can be read together, and the last stable one."""
        row = generic.consistent_point(self.progress(), *(t.name for t in self.tables)).first()
        return row["last_sync"], row["last_stable"]

    def _parquet(self, t: Table, names: list[str]) -> DataFrame:
        schema, where = f"{t.schema}, seq bigint, batch bigint, segment string, final boolean", f"{self.root}/{t.name}"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", where).parquet(*(f"{where}/segment={n}" for n in names))

    def _live(self, state: State) -> DataFrame:
        """The valid positions that are hot, and the stable one."""
        return self.spark.read.schema(_LIVE).parquet(f"{self.root}/_live/{state.hot[-1]}") if state.hot else self.spark.createDataFrame([], _LIVE)

    def _hot(self, t: Table, state: State, live: DataFrame | None = None) -> DataFrame:
        """The valid rows of the hot segments."""
        live = self._live(state) if live is None else live
        return self._parquet(t, state.hot).where("not final").drop("final", "segment").join(live.select("batch", "seq"), ["batch", "seq"], "left_semi")

    def _cold(self, t: Table, state: State) -> DataFrame:
        return self._shown(self._parquet(t, [r.name for r in state.cold]).where("final").select(*_names(t.schema)), state)

    def _shown(self, rows: DataFrame, state: State) -> DataFrame:
        return rows if state.pruned is None else rows.where(F.col("slot_no") > state.pruned)

    def _valid(self, t: Table, state: State) -> DataFrame:
        return self._cold(t, state).unionByName(self._shown(self._hot(t, state).select(*_names(t.schema)), state))

    def _spec(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    def positions(self) -> DataFrame:
        """The valid positions; `seq` is the number that the source gave."""
        return self._valid(_POSITIONS, self.state()).withColumnRenamed("arrival", "seq")

    def table(self, name: str, as_of: int | None = None, partial: bool = False) -> DataFrame:
        """The valid rows of a table, at a position or at the latest; with `is_stable`."""
        spec, state = self._spec(name), self.state()
        if as_of is not None and state.pruned is not None and as_of < state.pruned:
            raise NotStoredAnymore(f"asked for slot {as_of}, pruned up to {state.pruned}")
        rows = self._valid(spec, state)
        if spec.per_epoch:
            rows = generic.until(spec.reduced(rows).where(F.col("epoch_no") < _number(state.epoch)), as_of)
        else:
            rows = spec.reduced(generic.until(rows, as_of))
        out = changelog.with_stability(rows, state.stable)
        return generic.synced_only(lambda: out, as_of, state.last, partial)

    def hot_and_cold(self, name: str) -> tuple[DataFrame, DataFrame]:
        """The rows that a rollback may still take back, and those that are final."""
        state = self.state()
        return generic.hot_and_cold(self._valid(self._spec(name), state), -1 if state.stable is None else state.stable)

    def lookup(self, name: str, key, first: int | None = None, last: int | None = None) -> DataFrame:
        """The valid rows with a value of the table's key, of slots first..last: of laid out runs only the files that may have
        some are read."""
        spec, state = self._spec(name), self.state()
        found = self._among(spec, state, "_zones", _ZONES, lambda zones: layout.files_of_key(zones, key, first, last))
        rows = found.where(F.col(spec.key) == key)
        rows = rows if first is None else rows.where(F.col("slot_no") >= first)
        return changelog.with_stability(generic.until(rows, last), state.stable)

    def of_transaction(self, name: str, tx_id: str) -> DataFrame:
        """The valid rows with a tx_id; Bloom filters tell which files to read."""
        spec, state = self._spec(name), self.state()
        found = self._among(spec, state, "_blooms", _BLOOMS, lambda blooms: layout.files_of_value(self.spark, blooms, tx_id))
        return changelog.with_stability(found.where(F.col("tx_id") == tx_id), state.stable)

    def _among(self, spec: Table, state: State, kind: str, schema: str, choose: Callable[[DataFrame], list[str]]) -> DataFrame:
        laid = [r for r in state.cold if r.level]
        chosen = [f for r in laid for f in choose(self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{spec.name}/{r.name}"))]
        rows = self._valid(spec, dataclasses.replace(state, cold=[r for r in state.cold if not r.level]))
        if not chosen:
            return rows
        return self._shown(self.spark.read.schema(spec.schema).parquet(*chosen), state).unionByName(rows)


_ZONES = "file string, low bigint, high bigint, first bigint, last bigint, rows bigint"
_BLOOMS = "file string, part bigint, bits binary, size bigint"


def _together(work: list[Callable[[], None]], *sessions: SparkSession) -> None:
    with released(*sessions), ThreadPoolExecutor(len(work)) as pool:
        list(pool.map(lambda f: f(), work))


def _number(x: int | None) -> Column:
    return F.lit(x).cast("bigint")


def _names(schema: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(schema)]


def for_each(f: Callable) -> Callable[[DataFrame], None]:
    """An action that calls f with every block of a batch, on the executors."""
    return lambda blocks: blocks.foreach(f)
