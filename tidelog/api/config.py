"""Configuration in TOML; a key that isn't known is an error."""

from __future__ import annotations

import dataclasses
import tomllib
import types
import typing
from dataclasses import dataclass, field

from tidelog.errors import InvalidArgument


@dataclass
class Listen:
    graphql: str | None = None
    wire: str | None = None
    replication: str | None = None


@dataclass
class Graphql:
    max_body_bytes: int = 16 << 20
    fork_max_open: int = 8
    fork_idle_ttl_secs: int = 300


@dataclass
class Wire:
    max_frame_bytes: int = 64 << 20


@dataclass
class Replication:
    max_frame_bytes: int = 64 << 20
    ping_every_ms: int = 1000


@dataclass
class JournalOptions:
    dir: str | None = None
    rotate_bytes: int = 64 << 20
    compact_when_deltas_exceed: float = 2.0
    compact_min_bytes: int = 64 << 20


@dataclass
class Engine:
    create_if_missing: bool = True
    wasm_enabled: bool = True
    max_key_size: int = 16 << 10
    max_value_size: int = 256 << 20
    max_txn_write_bytes: int = 256 << 20
    sub_queue_bytes: int = 8 << 20
    execute_retries: int = 3
    trigger_batch: int = 512
    trigger_inline_value: int = 64 << 10
    tier_width: int = 4


@dataclass
class Config:
    dir: str = ""
    store_name: str | None = None
    sync: str = "always"
    listen: Listen = field(default_factory=Listen)
    graphql: Graphql = field(default_factory=Graphql)
    wire: Wire = field(default_factory=Wire)
    replication: Replication = field(default_factory=Replication)
    journal: JournalOptions = field(default_factory=JournalOptions)
    engine: Engine = field(default_factory=Engine)


def _built(kind: type, raw: dict, where: str) -> object:
    hints = typing.get_type_hints(kind)
    if unknown := set(raw) - set(hints):
        raise InvalidArgument(f"unknown key {where}{sorted(unknown)[0]}")
    out = {}
    for name, value in raw.items():
        of = hints[name]
        if dataclasses.is_dataclass(of):
            if not isinstance(value, dict):
                raise InvalidArgument(f"{where}{name} is a section")
            out[name] = _built(of, value, f"{where}{name}.")
            continue
        allowed = of.__args__ if isinstance(of, types.UnionType) else (of,)
        if float in allowed and type(value) is int:
            value = float(value)
        if type(value) not in allowed:
            raise InvalidArgument(f"{where}{name} isn't of type {allowed[0].__name__}")
        out[name] = value
    return kind(**out)


def parse(text: str) -> Config:
    try:
        config = _built(Config, tomllib.loads(text), "")
    except tomllib.TOMLDecodeError as error:
        raise InvalidArgument(f"not TOML: {error}") from None
    if config.sync not in ("always", "periodic", "never"):
        raise InvalidArgument("sync is always, periodic or never")
    return config
