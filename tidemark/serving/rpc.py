"""A JSON-RPC 2.0 dispatcher over the tables, and an optional HTTP server from the standard library."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable
from functools import reduce
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.errors import AheadOfLastSync, QueryError, SlotBoundsInvalid
from tidemark.operators import changelog, generic
from tidemark.plans import domain
from tidemark.streaming.ingest import Ingest

#: Rows of an answer at most; larger ones come in pages.
MOST = 100_000
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


class BadParams(Exception):
    pass


class Api:
    """The methods. `extra` has tables that are not part of the ingest: epoch_sdd, epoch_nonce. With `short`, stake comes
    without its epoch and an unknown nonce is null rather than an object of nulls."""

    def __init__(self, ingest: Ingest, tracked: list[str] | None = None, extra: dict[str, DataFrame] | None = None, depth: int = 2160, short: bool = False):
        self.ingest, self.tracked, self.extra, self.depth, self.short = ingest, tracked or [], extra or {}, depth, short
        self.methods: dict[str, Callable] = {
            "echo": lambda p: p,
            "getTargetAddresses": lambda p: self.tracked,
            "getUtxosFromAddress": self.utxos,
            "getBurnTokenEvents": self.burns,
            "getActiveStakePoolDelegationByEpoch": self.stake,
            "getNonceByEpoch": self.nonce,
            "getCurrentSyncedBlock": self.synced_block,
            "getAddressCount": self.address_count,
        }

    # --- methods

    def utxo_rows(self, p: dict, as_of: int | None = None) -> DataFrame:
        """The unspent outputs of an address, as a frame of any size."""
        address, low, high = _field(p, "address", str), p.get("createdAtOrAfterSlotNo"), p.get("unspentBeforeSlotNo")
        if low is not None and (high is None or low > high):
            raise BadParams("the slot interval is invalid")
        if self.tracked and address not in self.tracked:
            raise BadParams("the address is not tracked")
        upper = next((x for x in (high, as_of) if x is not None), self.ingest.point()[0])
        get = lambda name: self.ingest.table(name).drop("is_stable")
        outputs = self.ingest.lookup("utxo", address, low, upper).drop("is_stable")
        return domain.unspent_details(outputs, get("spent"), get("datum"), get("block_info"), F.lit(address), upper, low)

    def utxos(self, p: dict) -> list[dict] | dict:
        row = lambda r: {
            "slotNo": r.slot_no, "blockHeaderHash": r.block_hash, "epochNo": r.epoch_no, "blockNo": r.block_no, "txIndexInBlock": r.tx_index,
            "txId": r.tx_id, "txIx": r.tx_ix, "datumHash": r.datum_hash, "datum": r.datum, "value": r.value,
            "spentBy": None if r.spent_at_tx is None else {"slotNo": r.spent_slot, "txId": r.spent_at_tx},
            "txInputs": [{"txId": i.tx_id, "txIx": i.tx_ix} for i in r.tx_inputs or []],
        }
        return self._paged(p, self.utxo_rows, ["slot_no", "tx_index", "tx_ix", "tx_id"], row)

    def burn_rows(self, p: dict, as_of: int | None = None) -> DataFrame:
        """The burns of a policy, as a frame of any size."""
        policy, name, upper, after = _field(p, "policyId", str), p.get("assetName"), p.get("createdBeforeSlotNo"), p.get("createdAfterTx")
        sync, stable = self.ingest.point()
        rows = domain.asset_events(self.ingest.table("mint").drop("is_stable"), policy, name, "burn", upper, after, sync if as_of is None else as_of)
        if upper is None:
            return changelog.with_stability(rows, stable)
        return domain.with_depth_stability(rows, self.ingest.table("block_info"), upper, self.depth)

    def burns(self, p: dict) -> list[dict] | dict:
        row = lambda r: {"slotNo": r.slot_no, "blockHeaderHash": r.block_hash, "blockNo": r.block_no, "txId": r.tx_id, "redeemerHash": r.redeemer_hash, "redeemer": r.redeemer, "assetName": r.asset_name, "burnAmount": abs(r.quantity), "isStable": r.is_stable}
        return self._paged(p, self.burn_rows, ["slot_no", "block_no", "tx_index", "asset_name", "tx_id"], row)

    def _paged(self, p: dict, rows: Callable[[dict, int | None], DataFrame], order: list[str], as_json: Callable[[Row], dict]) -> list[dict] | dict:
        """A page of `pageSize` rows with the token of the next, or the whole answer if it is not asked for by pages and has at
        most MOST rows. A page begins after the sort key that its token has, at the position at which the first was read, so
        pages fit together while blocks arrive, and no page costs the rows before it."""
        size, token = p.get("pageSize") if isinstance(p, dict) else None, p.get("page") if isinstance(p, dict) else None
        if size is not None and (not isinstance(size, int) or isinstance(size, bool) or not 0 < size <= MOST):
            raise BadParams(f"pageSize is a number from 1 to {MOST}")
        as_of, after = _read_token(token, len(order)) if token is not None else (self.ingest.point()[0], None)
        found = rows(p, as_of)
        if after is not None:
            # greater in the order of all columns: greater in one, equal in those before
            found = found.where(reduce(Column.__or__, [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(order[:i], after)], F.lit(True)) & (F.col(order[i]) > F.lit(after[i])) for i in range(len(order))]))
        most = MOST if size is None else size
        some = found.orderBy(*order).limit(most + 1).collect()  # a page
        if size is None:
            if len(some) > most:
                raise BadParams(f"the answer has over {MOST} rows: ask for it with pageSize")
            return [as_json(r) for r in some]
        page = some[:most]
        more = len(some) > most
        return {"rows": [as_json(r) for r in page], "next": _token(as_of, [page[-1][c] for c in order]) if more else None}

    def stake(self, epoch: int) -> list[dict]:
        rows = domain.active_stake(self._extra("epoch_sdd"), _number(epoch)).orderBy("pool_id")
        out = [{"poolId": r.pool_id, "lovelace": r.lovelace, "slotNo": r.slot_no, "blockHeaderHash": r.block_hash, "blockNo": r.block_no, "epochNo": r.epoch_no} for r in rows.collect()]
        return [{k: v for k, v in r.items() if k != "epochNo"} for r in out] if self.short else out

    def nonce(self, epoch: int) -> dict | None:
        r = domain.nonce_of(self._extra("epoch_nonce"), _number(epoch)).first()
        if r is None and self.short:
            return None
        keys = {"blockHeaderHash": "block_hash", "blockNo": "block_no", "epochNo": "epoch_no", "slotNo": "slot_no", "nonce": "nonce"}
        return {k: None if r is None else r[v] for k, v in keys.items()}

    def synced_block(self, _=None) -> dict:
        sync, _stable = self.ingest.point()
        tip = self.ingest.positions().agg(F.max("tip_block_no")).first()[0]
        if sync is None:
            return {"nodeTip": {} if tip is None else {"blockNo": tip}}
        r = generic.last_event(generic.until(self.ingest.table("block_info"), sync), "block_hash", "block_no", "epoch_no", "block_timestamp").first()
        out = {"blockNo": r.block_no, "blockTimestamp": r.block_timestamp, "blockHeaderHash": r.block_hash, "slotNo": r.slot_no, "epochNo": r.epoch_no, "nodeTip": {"blockNo": tip}}
        return {k: v for k, v in out.items() if v is not None}

    def address_count(self, address: str) -> int:
        if not isinstance(address, str):
            raise BadParams("an address is a string")
        sync, _ = self.ingest.point()
        return 0 if sync is None else self.ingest.table("utxo", sync).where(F.col("address") == address).count()

    def _extra(self, name: str) -> DataFrame:
        if name not in self.extra and name in {t.name for t in self.ingest.tables}:
            return self.ingest.table(name).drop("is_stable")
        if name not in self.extra:
            raise QueryError(f"the table {name} is not indexed")
        return self.extra[name]

    # --- protocol

    def call(self, body: str | bytes) -> str:
        try:
            request = json.loads(body)
        except ValueError:
            return _answer(None, error=(PARSE, "Parse error"))
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return _answer(request.get("id") if isinstance(request, dict) else None, error=(INVALID, "Invalid request"))
        method = self.methods.get(request["method"])
        if method is None:
            return _answer(request.get("id"), error=(NO_METHOD, "Method not found"))
        try:
            return _answer(request.get("id"), method(request.get("params")))
        except (BadParams, SlotBoundsInvalid) as e:
            return _answer(request.get("id"), error=(BAD_PARAMS, str(e)))
        except AheadOfLastSync as e:
            return _answer(request.get("id"), error=(INTERNAL, f"ahead of the last sync: {e}"))
        except QueryError as e:
            return _answer(request.get("id"), error=(INTERNAL, str(e)))


def _token(as_of: int, key: list) -> str:
    return base64.urlsafe_b64encode(json.dumps([as_of, key]).encode()).decode()


def _read_token(token, width: int) -> tuple[int, list]:
    try:
        as_of, key = json.loads(base64.urlsafe_b64decode(token.encode()))
        if not isinstance(as_of, int) or len(key) != width or any(x is None for x in key):
            raise ValueError
    except (ValueError, TypeError, AttributeError) as e:
        raise BadParams("page is not a token of this method") from e
    return as_of, key


def _field(p, name: str, kind: type):
    if not isinstance(p, dict) or not isinstance(p.get(name), kind):
        raise BadParams(f"{name} is missing or has the wrong type")
    return p[name]


def _number(x) -> int:
    if not isinstance(x, int) or isinstance(x, bool) or x < 0:
        raise BadParams("an epoch is a number from 0 on")
    return x


def _plain(x):
    if isinstance(x, Decimal):
        return int(x)
    raise TypeError(type(x).__name__)


def _answer(id_, result=None, error: tuple[int, str] | None = None) -> str:
    body = {"error": {"code": error[0], "message": error[1]}} if error else {"result": result}
    return json.dumps({"jsonrpc": "2.0", "id": id_, **body}, default=_plain)


def serve(api: Api, port: int = 3000, metrics: Callable[[], str] = lambda: "", params: dict | None = None) -> ThreadingHTTPServer:
    """POST /json-rpc, and GET /time, /params, /addresses, /metrics. The caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, text: str, code: int = 200) -> None:
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        def do_GET(self) -> None:
            pages = {"/time": lambda: time.strftime("%H:%M:%S"), "/params": lambda: json.dumps(params or {}), "/addresses": lambda: json.dumps(api.tracked), "/metrics": metrics}
            page = pages.get(self.path)
            self._send(page() if page else "not found", 200 if page else 404)

        def do_POST(self) -> None:
            self._send(api.call(self.rfile.read(int(self.headers.get("Content-Length", 0)))))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
