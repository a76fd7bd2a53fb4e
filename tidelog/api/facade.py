"""The API's queries, mutations and subscriptions as methods, with their argument rules and error codes."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import functions as F

from tidelog import errors
from tidelog.functions import codecs
from tidelog.operators import mvcc
from tidelog.sources import modules
from tidelog.sources.store import DELETE, PUT, Snapshot, Store
from tidelog.streaming import subscriptions

#: Rows of a page unless given, and at most; the depth of a JSON argument.
PAGE, MOST_PAGE, MOST_DEPTH = 100, 10_000, 32


def answered(call: Callable) -> dict:
    """{data} of a call, or {error: {code, message, ...}}."""
    try:
        return {"data": call()}
    except errors.StoreError as error:
        more = {"exitCode": error.exit_code, "output": error.output} if isinstance(error, errors.GuestFailed) else {}
        more |= {"committed": error.committed} if isinstance(error, errors.OutputViolation) else {}
        return {"error": {"code": error.code, "message": str(error)} | more}


def _bound(given: dict | bytes | str | None) -> bytes | None:
    """Bytes given as they are, as text, or as {text | base64 | hex}."""
    if given is None or isinstance(given, bytes):
        return given
    if isinstance(given, str):
        return given.encode()
    if not set(given) <= {"text", "base64", "hex"}:
        raise errors.InvalidArgument("bytes are given as text, base64 or hex")
    return codecs.bytes_of(**given)


def _needed(given: dict | bytes | str | None, what: str) -> bytes:
    value = _bound(given)
    if value is None:
        raise errors.InvalidArgument(f"{what} is needed")
    return value


def _depth(value: object) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + max(map(_depth, inner), default=0)


class Api:
    """Reads are of the head, or of `at`, a seqno, where that is an argument."""

    def __init__(self, store: Store):
        self.store = store
        self._fields: dict[str, modules.Descriptor] | None = None
        self.schema_errors: dict[str, str] = {}

    def _at(self, at: int | None) -> Snapshot:
        return self.store.snapshot() if at is None else self.store.snapshot_at(at)

    # ---- queries ----

    def get(self, key, at: int | None = None) -> dict | None:
        value = self.store.get(_needed(key, "key"), self._at(at))
        return None if value is None else codecs.shown_bytes(value)

    def page(self, lo=None, hi=None, prefix=None, after=None, reverse: bool = False, limit: int | None = None, at: int | None = None, most: int = MOST_PAGE) -> tuple[list[tuple[bytes, bytes]], bool]:
        """Up to limit pairs strictly past the cursor `after`, and whether there are more."""
        limit = PAGE if limit is None else limit
        if not 1 <= limit <= most:
            raise errors.InvalidArgument(f"limit is 1 to {most}")
        lo, hi, prefix, after = map(_bound, (lo, hi, prefix, after))
        if prefix is not None:
            if lo is not None or hi is not None:
                raise errors.InvalidArgument("a prefix goes without lo and hi")
            lo, hi = prefix or None, codecs.prefix_end(prefix)
        if after is not None and reverse:
            hi = after if hi is None else min(hi, after)
        elif after is not None:
            lo = after + b"\x00" if lo is None else max(lo, after + b"\x00")
        snapshot = self._at(at)
        order = F.col("key").desc() if reverse else F.col("key").asc()
        rows = mvcc.latest(self.store.log(snapshot, lo, hi)).orderBy(order).limit(limit + 1).collect()
        return [(bytes(r.key), bytes(r.value)) for r in rows[:limit]], len(rows) > limit

    def scan(self, **arguments) -> dict:
        pairs, more = self.page(**arguments)
        return {"entries": [{"key": codecs.shown_bytes(k), "value": codecs.shown_bytes(v)} for k, v in pairs], "hasMore": more, "nextAfter": codecs.shown_bytes(pairs[-1][0]) if more else None}

    def count(self, lo=None, hi=None, at: int | None = None) -> int:
        lo, hi = _bound(lo), _bound(hi)
        return mvcc.latest(self.store.log(self._at(at), lo, hi)).count()

    def wasm(self, name: str, args: object = None, at: int | None = None) -> object:
        return self._shaped(self.store.query(name, self._json(args), self._at(at)))

    def modules(self) -> list[dict]:
        self.reloadSchema()
        return [r.asDict() | {"typed": r.name in self._fields, "schemaError": self.schema_errors.get(r.name)} for r in self.store.modules().orderBy("name").collect()]

    def stats(self) -> list[dict]:
        return [r.asDict() for r in self.store.stats().orderBy("tier").collect()]

    def forks(self) -> list[dict]:
        return [r.asDict() for r in self.store.forks().collect()]

    def pins(self) -> list[dict]:
        return [r.asDict() for r in self.store.pins().collect()]

    def triggers(self) -> list[dict]:
        return [r.asDict() | {"lo": codecs.shown_bytes(bytes(r.lo)), "hi": codecs.shown_bytes(bytes(r.hi))} for r in self.store.triggers().orderBy("name").collect()]

    def seqno(self) -> int:
        return self.store.seqno()

    def snapshotSeqno(self, at: int | None = None) -> int:  # noqa: N802
        return self._at(at).seqno

    # ---- mutations ----

    def put(self, key, value) -> int:
        return self.store.put(_needed(key, "key"), _needed(value, "value"))

    def delete(self, key) -> int:
        return self.store.delete(_needed(key, "key"))

    def writeBatch(self, ops: list[dict]) -> int:  # noqa: N802
        """Operations {put: {key, value}} or {delete: {key}} as one commit; returns how many they are."""
        batch = []
        for op in ops:
            if len(op) != 1 or set(op) - {"put", "delete"}:
                raise errors.InvalidArgument("an operation is one put or one delete")
            (kind, fields), = op.items()
            batch.append((PUT, _needed(fields.get("key"), "key"), _needed(fields.get("value"), "value")) if kind == "put" else (DELETE, _needed(fields.get("key"), "key"), None))
        self.store.write(batch)
        return len(batch)

    def wasmExecute(self, name: str, args: object = None) -> object:  # noqa: N802
        return self._shaped(self.store.execute(name, self._json(args)))

    def installModule(self, name: str, module: modules.Module) -> list[dict]:  # noqa: N802
        self.store.install(name, module)
        return self.modules()

    def uninstallModule(self, name: str) -> bool:  # noqa: N802
        self.store.uninstall(name)
        self.reloadSchema()
        return True

    def createTrigger(self, name: str, module: str, lo, hi) -> bool:  # noqa: N802
        self.store.create_trigger(name, _needed(lo, "lo"), _needed(hi, "hi"), module=module)
        return True

    def deleteTrigger(self, name: str) -> bool:  # noqa: N802
        self.store.delete_trigger(name)
        return True

    def fork(self, name: str, path: str, at: int | None = None) -> dict:
        made = self.store.fork(name, path) if at is None else self.store.fork_at(name, path, at)
        return {"name": name, "instanceId": made.manifest().identity, "lastSeqno": made.seqno()}

    def deleteFork(self, name: str) -> bool:  # noqa: N802
        self.store.delete_fork(name)
        return True

    def pin(self, name: str, seqno: int | None = None) -> bool:
        self.store.pin(name, seqno)
        return True

    def unpin(self, name: str) -> bool:
        self.store.unpin(name)
        return True

    def syncWal(self) -> bool:  # noqa: N802
        """Commits are durable when they return, so there is nothing to wait for."""
        return True

    flush = syncWal

    def compactAll(self) -> bool:  # noqa: N802
        self.store.compact()
        return True

    def gcVlog(self, olderThanMs: int = 3_600_000) -> int:  # noqa: N802, N803
        return len(self.store.vacuum(olderThanMs))

    # ---- typed fields ----

    def reloadSchema(self) -> list[str]:  # noqa: N802
        """Reads the declarations of the installed modules; one that isn't sound leaves its module untyped, with the error noted."""
        fields, wrong = {}, {}
        at = self.store.snapshot()
        for r in self.store.modules(at).collect():
            try:
                entry = self.store._versions_of(at.manifest, r.name, at.seqno)
                declared = modules.loads(self.store.files.read_bytes(entry["path"]), entry["hash"]).descriptor()
                if declared is not None:
                    fields[r.name] = declared
            except errors.StoreError as error:
                wrong[r.name] = str(error)
        self._fields, self.schema_errors = fields, wrong
        return sorted(fields)

    def field(self, name: str, **given) -> object:
        """A module's typed field: its arguments checked and completed, its output as declared."""
        if self._fields is None or name not in self._fields:
            self.reloadSchema()
        declared = self._fields.get(name)
        if declared is None or declared.kind is None:
            raise errors.InvalidArgument(f"no field {name}")
        arguments = declared.arguments(given)
        return self.store.query(name, arguments) if declared.kind == "query" else self.store.execute(name, arguments)

    # ---- subscriptions ----

    def changes(self, lo=None, hi=None, after: int | None = None, polls: int = 1, query: Callable[[Api], object] | None = None) -> Iterator[dict]:
        """ATTACHED, then the changes in [lo, hi), each with the result of a query over the state at its commit."""
        for item in subscriptions.changes(self.store, _bound(lo), _bound(hi), after, polls):
            shown = item | {"key": None if item["key"] is None else codecs.shown_bytes(item["key"]), "value": None if item["value"] is None else codecs.shown_bytes(item["value"])}
            if query is not None and item["op"] != "ATTACHED":
                shown["query"] = query(_Pinned(self.store, Snapshot(self.store.manifest(), item["commit_seqno"])))
            yield shown

    def feed(self, module: str, after: int = 0) -> Iterator[dict]:
        """The typed events of a module's feed past a seqno."""
        self.reloadSchema()
        declared = self._fields.get(module)
        if declared is None or declared.feed_prefix is None:
            raise errors.InvalidArgument(f"module {module} has no feed")
        prefix = declared.feed_prefix.encode()
        rows = subscriptions.subscribe(self.store.log(lo=prefix, hi=codecs.prefix_end(prefix), after=after), None, None, after)
        return subscriptions.feed(rows, prefix, declared)

    @staticmethod
    def _json(args: object) -> object:
        if args is not None and _depth(args) > MOST_DEPTH:
            raise errors.InvalidArgument(f"arguments are nested deeper than {MOST_DEPTH}")
        try:
            json.dumps(args)
        except (TypeError, ValueError) as error:
            raise errors.InvalidArgument(f"arguments aren't JSON: {error}") from None
        return args

    @staticmethod
    def _shaped(out: object) -> object:
        return codecs.shown_bytes(bytes(out)) if isinstance(out, bytes | bytearray) else out


class _Pinned(Api):
    """An Api whose reads are of one snapshot, whatever seqno they name."""

    def __init__(self, store: Store, at: Snapshot):
        super().__init__(store)
        self._fixed = at

    def _at(self, at: int | None) -> Snapshot:
        return self._fixed


class Instances:
    """Stores by instance id: the root, and forks of forks down to `depth`, opened when asked for; few stay open, unused ones not for long."""

    def __init__(self, root: Store, most: int = 8, idle_seconds: float = 300, depth: int = 8):
        self.root, self.most, self.idle, self.depth = root, most, idle_seconds, depth
        self._open: OrderedDict[str, tuple[Store, str, float]] = OrderedDict()

    def _find(self, instance: str) -> str:
        """The path of the fork with this id, level by level."""
        level = [self.root.manifest()]
        for _ in range(self.depth):
            deeper = []
            for m in level:
                for fork in m.forks.values():
                    if fork["identity"] == instance:
                        return fork["path"]
                    deeper.append(Store(self.root.spark, fork["path"]).manifest())
            level = deeper
        raise errors.InvalidArgument(f"no instance {instance}")

    def get(self, instance: str | None = None) -> Store:
        if instance is None or instance == self.root.manifest().identity:
            return self.root
        self.expire()
        if instance in self._open:
            store, mark, _ = self._open.pop(instance)
        else:
            store = Store(self.root.spark, self._find(instance))
            mark = store.open()
        self._open[instance] = (store, mark, time.time())
        while len(self._open) > self.most:
            self._close(next(iter(self._open)))
        return store

    def expire(self) -> None:
        for instance in [i for i, (_, _, used) in self._open.items() if used < time.time() - self.idle]:
            self._close(instance)

    def _close(self, instance: str) -> None:
        store, mark, _ = self._open.pop(instance)
        store.close(mark)

    def close(self) -> None:
        for instance in list(self._open):
            self._close(instance)
