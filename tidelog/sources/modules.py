"""Modules: code with roles that a store keeps, and the types that it declares.

A module is a set of functions. query(view, args) reads; execute(txn, args) reads and writes,
and is committed when it returns; on_touch(txn, keys) and on_apply(txn, changes) run for
triggers, over DataFrames. describe declares a typed field: arguments, output, or a feed. A
store runs what was installed in it, so whoever may install code may run it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tidelog import errors
from tidelog.functions.codecs import check_name, content_hash

ROLES = ("query", "execute", "on_touch", "on_apply")
#: Bytes of arguments, output and log lines (as JSON), and scans of one run. What a run computes isn't metered.
MAX_INPUT, MAX_OUTPUT, MAX_LOG, MAX_SCANS = 64 << 20, 32 << 20, 1 << 20, 64
MAX_DESCRIPTOR, MAX_TYPES, MAX_FIELDS, MAX_ARGS = 64 << 10, 32, 64, 16
SCALARS = ("String", "Int", "Float", "Boolean", "U64", "Json")
#: Names of the facade that a module with a typed field can't have.
RESERVED = frozenset(
    "get scan wasm modules stats forks pins triggers snapshotSeqno seqno changes put delete writeBatch wasmExecute installModule "
    "uninstallModule createTrigger deleteTrigger reloadSchema fork deleteFork pin unpin syncWal flush compactAll gcVlog".split()
)


class Fail(errors.GuestFailed):
    """Raised by a module to end without effects: a code (0 counts as 1) and a message."""

    def __init__(self, code: int = 1, message: object = None):
        super().__init__(code, message)

    def __reduce__(self):
        return Fail, (self.exit_code, self.output)


@dataclass(frozen=True)
class Type:
    """A declared type: T, T!, [T], [T!], [T]! or [T!]!."""

    base: str
    required: bool = False
    many: bool = False
    item_required: bool = False

    @classmethod
    def parse(cls, text: str) -> Type:
        m = re.fullmatch(r"(?:\[([A-Za-z_]\w*)(!?)\]|([A-Za-z_]\w*))(!?)", text or "")
        if m is None:
            raise errors.InvalidArgument(f"not a type: {text}")
        return cls(m[1] or m[3], bool(m[4]), m[1] is not None, bool(m[2]))


@dataclass
class Descriptor:
    """What a module declares."""

    kind: str | None = None
    args: dict[str, Type] = field(default_factory=dict)
    output: Type | None = None
    types: dict[str, dict[str, Type]] = field(default_factory=dict)
    feed_prefix: str | None = None
    feed_event: Type | None = None

    @classmethod
    def parse(cls, raw: dict, module: str, roles: list[str]) -> Descriptor:
        """Checks a declaration: {kind, args, output, types, feed: {prefix, event}}; InvalidArgument tells what is wrong."""

        def need(ok: object, message: str) -> None:
            if not ok:
                raise errors.InvalidArgument(f"module {module}: {message}")

        need(len(json.dumps(raw)) <= MAX_DESCRIPTOR, f"the declaration is over {MAX_DESCRIPTOR} bytes")
        need(set(raw) <= {"kind", "args", "output", "types", "feed"}, "the declaration has unknown parts")
        need(re.fullmatch(r"[A-Za-z_]\w*", module) and not module.startswith("__"), "its name can't be that of a field")
        need(module not in RESERVED, "its name is that of a built-in field")
        kind, output, feed = raw.get("kind"), raw.get("output"), raw.get("feed")
        need(kind in (None, "query", "execute"), "kind is query or execute")
        need(kind or feed, "neither kind nor feed is declared")
        need(bool(kind) == bool(output), "kind and output go together")
        need(kind or not raw.get("args"), "only a kind takes arguments")
        need(not kind or kind in roles, f"it has no role {kind}")
        declared = raw.get("types", {})
        need(len(declared) <= MAX_TYPES, f"more than {MAX_TYPES} types")
        types: dict[str, dict[str, Type]] = {}
        for name, fields in declared.items():
            need(re.fullmatch(r"[A-Za-z_]\w*", name) and not name.startswith("__") and name not in SCALARS, f"type name {name}")
            need(0 < len(fields) <= MAX_FIELDS, f"type {name} has 1 to {MAX_FIELDS} fields")
            types[name] = {f: Type.parse(t) for f, t in fields.items()}
            need(all(re.fullmatch(r"[A-Za-z_]\w*", f) for f in fields), f"field names of type {name}")
        known = lambda t: t.base in SCALARS or t.base in types
        need(all(known(t) for fields in types.values() for t in fields.values()), "a field is of an unknown type")
        args = {a: Type.parse(t) for a, t in raw.get("args", {}).items()}
        need(len(args) <= MAX_ARGS, f"more than {MAX_ARGS} arguments")
        need(all(t.base in SCALARS for t in args.values()), "arguments are of scalar types")
        out = Type.parse(output) if output else None
        need(out is None or known(out), "output is of an unknown type")
        event = None
        if feed:
            prefix = feed.get("prefix")
            need(isinstance(prefix, str) and prefix and "\0" not in prefix, "a feed has a prefix that isn't empty and without NUL")
            event = Type.parse(feed.get("event"))
            need(known(event) and not event.many, "a feed's event is of a known type, not a list")
        return cls(kind, args, out, types, feed["prefix"] if feed else None, event)

    def normalize(self, value: object, of: Type | None = None, where: str = "output") -> object:
        """value as its type has it: declared fields alone, absent ones null; ValueError where it doesn't fit."""
        of = of or self.output
        if value is None:
            if of.required:
                raise ValueError(f"{where} is null")
            return None
        if of.many:
            if not isinstance(value, list):
                raise ValueError(f"{where} isn't a list")
            item = Type(of.base, of.item_required)
            return [self.normalize(v, item, f"{where}[{k}]") for k, v in enumerate(value)]
        if of.base in self.types:
            if not isinstance(value, dict):
                raise ValueError(f"{where} isn't an object")
            return {f: self.normalize(value.get(f), t, f"{where}.{f}") for f, t in self.types[of.base].items()}
        return scalar(of.base, value, where)

    def arguments(self, given: dict) -> dict:
        """Every declared argument, omitted ones null; a single value for a list is a list of one."""
        if unknown := set(given) - set(self.args):
            raise errors.InvalidArgument(f"unknown arguments: {', '.join(sorted(unknown))}")
        out = {}
        for name, of in self.args.items():
            value = given.get(name)
            if of.many and value is not None and not isinstance(value, list):
                value = [value]
            try:
                out[name] = self.normalize(value, of, name)
            except ValueError as error:
                raise errors.InvalidArgument(str(error)) from None
        return out


def scalar(base: str, value: object, where: str) -> object:
    """A scalar checked: Int has 32 bits, Float is finite, U64 is a number or its digits and leaves as digits, Json is anything."""
    number = isinstance(value, int) and not isinstance(value, bool)
    if base == "Json":
        return value
    if base == "String" and isinstance(value, str) or base == "Boolean" and isinstance(value, bool):
        return value
    if base == "Int" and number and -(1 << 31) <= value < 1 << 31:
        return value
    if base == "Float" and (number or isinstance(value, float)) and math.isfinite(value):
        return float(value)
    if base == "U64" and (number or isinstance(value, str) and re.fullmatch(r"[0-9]{1,20}", value)) and 0 <= int(value) < 1 << 64:
        return str(int(value))
    raise ValueError(f"{where} isn't of type {base}")


@dataclass
class Module:
    query: Callable | None = None
    execute: Callable | None = None
    on_touch: Callable | None = None
    on_apply: Callable | None = None
    describe: dict | None = None
    name: str = ""

    def roles(self) -> list[str]:
        return [r for r in ROLES if getattr(self, r) is not None]

    def check(self, name: str) -> None:
        check_name(name, "module name")
        if not self.roles():
            raise errors.InvalidArgument("a module needs a role")
        self.name = name
        if self.describe is not None:
            self.descriptor()

    def descriptor(self) -> Descriptor | None:
        return None if self.describe is None else Descriptor.parse(self.describe, self.name, self.roles())

    def dumps(self) -> bytes:
        return cloudpickle.dumps(self)

    def run(self, role: str, view, args: object) -> object:
        """The role's result. Fail passes; any other error of the module's own is a GuestFailed of code 1."""
        if not isinstance(args, DataFrame) and args is not None:
            if len(json.dumps(args, default=_as_text)) > MAX_INPUT:
                raise errors.InvalidArgument(f"arguments are over {MAX_INPUT} bytes")
        try:
            return getattr(self, role)(view, args)
        except (errors.StoreError, MemoryError):
            raise
        except Exception as error:
            raise errors.GuestFailed(1, f"{type(error).__name__}: {errors.brief(error)}") from error

    def fitted(self, out: object, committed: bool) -> object:
        """The output as declared; OutputViolation if it doesn't fit, with whether its writes were committed."""
        if isinstance(out, DataFrame):
            return out
        if out is not None and len(json.dumps(out, default=_as_text)) > MAX_OUTPUT:
            raise errors.OutputViolation(f"output is over {MAX_OUTPUT} bytes", committed)
        declared = self.descriptor()
        if declared is None or declared.output is None:
            return out
        try:
            return declared.normalize(out)
        except ValueError as error:
            raise errors.OutputViolation(str(error), committed) from None


def _as_text(value: object) -> str:
    return value.decode(errors="replace") if isinstance(value, bytes | bytearray) else str(value)


def loads(data: bytes | None, expected: str) -> Module:
    if data is None or content_hash(data) != expected:
        raise errors.Corruption("a module's code is missing or isn't what was installed")
    return cloudpickle.loads(data)


def _role(role: str):
    def mark(f: Callable) -> Module:
        return Module(**{role: f})

    return mark


#: Decorators that make a module of one function.
query, execute, on_touch, on_apply = map(_role, ROLES)
