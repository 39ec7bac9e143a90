"""Command line: ingest a recorded log and serve its tables.

    python -m tidemark.serving.cli --log FOLDER --tables FOLDER --port 3000
"""

from __future__ import annotations

import argparse
import signal

from pyspark.sql import SparkSession

from tidemark.operators import preprocess
from tidemark.serving.rpc import Api, serve
from tidemark.sources import chain, event_store
from tidemark.streaming.ingest import Ingest, Settings, configured
from tidemark.streaming.stats import SyncStats, log_backend, metrics_text


def start_point(text: str) -> tuple[int | None, str | None]:
    """'genesis', or 'slot:hash'."""
    slot, _, block_hash = text.partition(":")
    return (None, None) if text == "genesis" else (int(slot), block_hash or None)


def asset(text: str) -> tuple[str, str | None]:
    """'policy' for all its assets, or 'policy.name'."""
    policy, _, name = text.partition(".")
    return policy, name or None


def block_range(text: str) -> tuple[int, int]:
    """'from-to', in block numbers."""
    low, _, high = text.partition("-")
    return preprocess.block_range(int(low), int(high))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--log", required=True, help="folder of the recorded log")
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--start", default="genesis", help="where to start: genesis, or slot:hash")
    p.add_argument("--files-per-batch", type=int, default=100)
    p.add_argument("--address", action="append", default=[], help="tracked address; all if none is given")
    p.add_argument("--asset", action="append", default=[], type=asset, help="tracked policy or policy.name")
    p.add_argument("--no-scripts", action="store_true")
    p.add_argument("--depth", type=int, default=2160, help="blocks below the tip at which one is final")
    p.add_argument("--retry-seconds", type=float, default=1800.0, help="how long to retry a source that is away")
    p.add_argument("--prune-every", type=int, help="slots between prunings of what is final; none if not given")
    p.add_argument("--blocks", type=block_range, action="append", default=[], help="from-to: write these blocks to --snapshots instead")
    p.add_argument("--snapshots", help="folder of the block ranges")
    p.add_argument("--port", type=int, help="serve after the ingest")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> Ingest:
    """Ingests what is there. A restart goes back to what is final and reads the log from there on, as another source."""
    tables = configured(list(dict.fromkeys(args.address)), list(dict.fromkeys(args.asset)), not args.no_scripts)
    ingest = Ingest(spark, args.tables, tables, Settings(depth=args.depth, prune_every=args.prune_every, stats=SyncStats(log_backend)))
    slot, block_hash = start_point(args.start)
    chain.check_start(chain.read_log(spark, args.log), slot, block_hash)

    ingest.reopen()
    checkpoint = f"{args.tables.rstrip('/')}/_checkpoint/{ingest.state().incarnation}"

    def attempt() -> None:
        query = ingest.start(chain.starting_at(chain.stream_log(spark, args.log, args.files_per_batch), slot), checkpoint)
        signal.signal(signal.SIGTERM, lambda *_: query.stop())
        query.awaitTermination()

    chain.retried(attempt, longest=args.retry_seconds)
    ingest.settings.stats.report()
    return ingest


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if args.blocks:
        for low, high in args.blocks:
            event_store.write_range(chain.read_log(spark, args.log), low, high, f"{args.snapshots}/{low}-{high}")
        return
    ingest = run(spark, args)
    if args.port is not None:
        metrics = lambda: metrics_text(ingest.settings.stats)
        serve(Api(ingest, args.address, depth=args.depth), args.port, metrics, {"depth": args.depth}).serve_forever()


if __name__ == "__main__":
    main()
