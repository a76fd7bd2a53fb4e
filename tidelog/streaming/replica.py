"""A replica of a key range: a slice of a store's segments, and the changes that came after it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidelog import errors
from tidelog.functions.codecs import check_key
from tidelog.operators import mvcc
from tidelog.sources.store import SCHEMA, Snapshot, Store
from tidelog.streaming.subscriptions import LAG_BYTES, Subscription


@dataclass
class Replica:
    """Reads are those of [lo, hi) alone: a get outside is an error, a scan is narrowed to it."""

    path: str
    lo: bytes | None = None
    hi: bytes | None = None
    identity: str | None = None
    flushed: int = 0  # seqno of the slice
    position: int = 0  # seqno that changes have been taken to
    segments: list[str] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)
    resyncs: int = 0

    def attach(self, master: Store, lag_bytes: int = LAG_BYTES) -> Subscription:
        """Takes the slice of the range from the master and subscribes past it. A master of another identity wipes what there was."""
        m = master.manifest()
        if not m.identity:
            raise errors.ProvenanceMismatch("a store without a name can't be replicated")
        if self.identity not in (None, m.identity):
            self.segments, self.changes, self.flushed, self.position = [], [], 0, 0
        self.identity, self._master = m.identity, master
        at = Snapshot(m, m.head)
        self._install(at)
        return Subscription(master, self.lo, self.hi, self.position, lag_bytes)

    def _install(self, at: Snapshot) -> None:
        """A new slice; changes up to its seqno are dropped from the overlay."""
        master = self._master
        folder = f"{self.path.rstrip('/')}/slice-{at.seqno:020}"
        rows = mvcc.versioned(master.log(at, self.lo, self.hi))
        rows.selectExpr("key", "seqno", "commit_seqno", "kind", "value", "'system' AS origin").write.mode("overwrite").parquet(folder)
        self.segments, self.flushed = [folder], at.seqno
        self.position = max(self.position, at.seqno)

    def apply(self, batch: DataFrame, number: int, upto: int) -> None:
        """Adds changes (seqno, commit_seqno, op, key, value) up to a seqno; a batch that came before is written over."""
        bad = batch.where("op = 'PUT' AND value IS NULL")
        if not bad.isEmpty():
            raise errors.Corruption("a put without a value")
        rows = batch.where(mvcc.in_range(batch.key, self.lo, self.hi)).selectExpr("key", "seqno", "commit_seqno", "CAST(op = 'PUT' AS INT) AS kind", "value", "'system' AS origin")
        folder = f"{self.path.rstrip('/')}/changes-{number:020}"
        rows.write.mode("overwrite").parquet(folder)
        if folder not in self.changes:
            self.changes.append(folder)
        self.position = max(self.position, upto)

    def follow(self, subscription: Subscription) -> Subscription:
        """Takes what there is. When it has lagged too far, or the master no longer has what is missing, it takes a new slice."""
        try:
            at = self._master.snapshot()
            if at.seqno > subscription.position:
                self.apply(subscription.poll().where(f"seqno <= {at.seqno}"), len(self.changes) + 1, at.seqno)
                subscription.advance(at.seqno)
            return subscription
        except (errors.Lagged, errors.Gone):
            self.resyncs += 1
            self.changes = []
            return self.attach(self._master, subscription.lag_bytes)

    def _log(self) -> DataFrame:
        spark = self._master.spark
        read = lambda paths: spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
        return read(self.segments).unionByName(read(self.changes).where(f"seqno > {self.flushed}"))

    def get(self, key: bytes) -> bytes | None:
        mvcc.in_scope(check_key(key), self.lo, self.hi)
        row = mvcc.get(self._log(), key).first()
        return bytes(row.value) if row else None

    def scan(self, lo: bytes | None = None, hi: bytes | None = None, reverse: bool = False) -> DataFrame:
        lo = self.lo if lo is None else lo if self.lo is None else max(lo, self.lo)
        hi = self.hi if hi is None else hi if self.hi is None else min(hi, self.hi)
        return mvcc.scan(self._log(), lo, hi, reverse=reverse)

    def stats(self) -> dict:
        return {"identity": self.identity, "lo": self.lo, "hi": self.hi, "flushed_seqno": self.flushed, "position": self.position, "overlay_batches": len(self.changes), "resyncs": self.resyncs}
