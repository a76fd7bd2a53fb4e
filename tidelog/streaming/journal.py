"""A journal of a store: a base and the changes after it, from which the store can be rebuilt elsewhere.

A folder holds numbered parts: base-<n> is a whole state at a seqno, delta-<n> the changes from
one seqno to another. A part is Parquet, and its header, which is published last, says whose it
is, which seqnos it covers and how large it is; without header it isn't part of the journal.
Checkpoints rise by one with each base, and what precedes the newest base can be pruned.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.operators import mvcc
from tidelog.sources.files import Files
from tidelog.sources.store import DELETE, PUT, SCHEMA, Snapshot, Store

BASE, DELTA = "base", "delta"


class Journal:
    def __init__(self, store: Store, path: str, compact_when: float = 2.0, compact_least: int = 64 << 20):
        """compact_when: with deltas of so many times the base's bytes, and compact_least at least, drain makes a new base."""
        self.store, self.path, self.files = store, path.rstrip("/"), Files(store.spark)
        self.compact_when, self.compact_least = compact_when, compact_least
        self.consumer = f"journal-{self.path}"

    @classmethod
    def attach(cls, store: Store, path: str, **options) -> Journal:
        """Goes on with the journal at path, or begins it with a base; that of another store is refused."""
        own = cls(store, path, **options)
        found = headers(own.files, own.path)
        if found:
            if any(h["identity"] != store.manifest().identity for h in found):
                raise errors.ProvenanceMismatch("the journal is that of another store")
            check(found)
            store.hold(own.consumer, found[-1]["last"])
        else:
            own.base()
        return own

    def _write(self, kind: str, rows: DataFrame, first: int, last: int, checkpoint: int) -> None:
        number = len(headers(self.files, self.path, False)) + 1
        name = f"{kind}-{number:010}"
        self.files.delete(f"{self.path}/{name}")  # one without a header was cut short
        rows.repartitionByRange("key").sortWithinPartitions("key", "seqno").write.parquet(f"{self.path}/{name}")
        size = sum(self._size(f"{self.path}/{name}"))
        header = {"kind": kind, "number": number, "identity": self.store.manifest().identity, "first": first, "last": last, "checkpoint": checkpoint, "bytes": size}
        if not self.files.publish(f"{self.path}/_headers/{number:010}.json", json.dumps(header)):
            raise errors.Conflict("another writer appends to this journal")

    def _size(self, path: str) -> list[int]:
        fs, p = self.files._at(path)
        return [s.getLen() for s in fs.listStatus(p)]

    def base(self) -> None:
        """Begins a new checkpoint: the state at the head."""
        found = headers(self.files, self.path, False)
        at = self.store.snapshot()
        rows = mvcc.latest(self.store.log(at)).select("key", "seqno", F.col("seqno").alias("commit_seqno"), F.lit(PUT).alias("kind"), "value", F.lit("system").alias("origin"))
        self._write(BASE, rows, 0, at.seqno, (found[-1]["checkpoint"] if found else 0) + 1)
        self.store.hold(self.consumer, at.seqno)

    def drain(self) -> int:
        """Adds what was committed since as a delta, or a new base where the store no longer has it or deltas have grown; returns the position."""
        found = headers(self.files, self.path)
        last = found[-1]["last"]
        at = self.store.snapshot()
        if last < at.manifest.watermark:
            self.base()
        elif last < at.seqno:
            self._write(DELTA, self.store.log(at, after=last).orderBy("seqno"), last, at.seqno, found[-1]["checkpoint"])
            self.store.hold(self.consumer, at.seqno)
            now = of_checkpoint(headers(self.files, self.path))
            deltas = sum(h["bytes"] for h in now[1:])
            if deltas >= max(self.compact_least, self.compact_when * now[0]["bytes"]):
                self.compact()
        return headers(self.files, self.path)[-1]["last"]

    def compact(self) -> None:
        """A new base, and the parts before it gone."""
        self.base()
        self.prune()

    def prune(self) -> None:
        """Deletes the parts before the newest base."""
        found = headers(self.files, self.path)
        for h in found[: found.index(of_checkpoint(found)[0])]:
            self.files.delete(f"{self.path}/_headers/{h['number']:010}.json")
            self.files.delete(f"{self.path}/{h['kind']}-{h['number']:010}")

    def detach(self) -> None:
        self.store.hold(self.consumer, None)


def headers(files: Files, path: str, strict: bool = True) -> list[dict]:
    """The headers in order. The last may be torn, one before it may not: that is corruption."""
    out = []
    names = sorted(n for n in files.names(f"{path}/_headers") if n.endswith(".json"))
    for k, name in enumerate(names):
        try:
            out.append(json.loads(files.read(f"{path}/_headers/{name}")))
        except ValueError:
            if strict and k < len(names) - 1:
                raise errors.Corruption(f"header {name} can't be read") from None
    return out


def check(found: list[dict]) -> None:
    """JournalGap where a delta doesn't go on where the part before it ended; Corruption where seqnos or checkpoints go back."""
    for a, b in zip(found, found[1:]):
        if b["identity"] != a["identity"]:
            raise errors.ProvenanceMismatch("parts of different stores")
        if b["last"] < a["last"] or b["checkpoint"] < a["checkpoint"]:
            raise errors.Corruption(f"part {b['number']} goes back")
        if b["kind"] == DELTA and (b["first"] != a["last"] or b["number"] != a["number"] + 1):
            raise errors.JournalGap(f"part {b['number']} begins at {b['first']}, the one before ends at {a['last']}")


def of_checkpoint(found: list[dict]) -> list[dict]:
    """The newest base and the deltas after it."""
    at = max((k for k, h in enumerate(found) if h["kind"] == BASE), default=None)
    if at is None:
        raise errors.Corruption("the journal has no base")
    return found[at:]


def _rows(spark: SparkSession, path: str, h: dict) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/{h['kind']}-{h['number']:010}")
    except Exception as error:
        raise errors.Corruption(f"part {h['number']} is missing: {error}") from None


def state(spark: SparkSession, path: str, identity: str | None = None) -> tuple[DataFrame, int]:
    """The state (key, seqno, value) that a journal holds, and its seqno. Parts that don't fit together raise."""
    files, path = Files(spark), path.rstrip("/")
    found = headers(files, path)
    if identity is not None and any(h["identity"] != identity for h in found):
        raise errors.ProvenanceMismatch("the journal is that of another store")
    parts = of_checkpoint(found)
    check(parts)
    deltas = [_rows(spark, path, h) for h in parts[1:]]
    changes = deltas[0] if deltas else spark.createDataFrame([], SCHEMA)
    for more in deltas[1:]:
        changes = changes.unionByName(more)
    outside = changes.where((F.col("seqno") <= parts[0]["last"]) | (F.col("seqno") > parts[-1]["last"]) | ~F.col("kind").isin(PUT, DELETE))
    if not outside.isEmpty():
        raise errors.Corruption("a delta holds changes outside its range")
    return mvcc.rebuild(_rows(spark, path, parts[0]).select("key", "seqno", "value"), changes), parts[-1]["last"]


def rebuild(spark: SparkSession, path: str, dest: str, name: str) -> Store:
    """A new store with the state of a journal: user keys and values, numbered anew."""
    rows, _ = state(spark, path)
    store = Store.create(spark, dest, name)
    store.write_frame(rows.select(F.col("seqno").alias("ord"), F.lit(PUT).alias("kind"), "key", "value"))
    return store


def equal_state(store: Store, path: str) -> bool:
    """Whether a journal's state is the store's at the journal's seqno."""
    rows, seqno = state(store.spark, path, store.manifest().identity)
    now = mvcc.latest(store.log(Snapshot(store.manifest(), seqno)))
    mine, theirs = rows.select("key", "value"), now.select("key", "value")
    return mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
