"""Subscriptions to a store's commits: by polling, and on Structured Streaming.

Both go by manifests, never by files: a position is a seqno, a step takes the versions past it
up to the head of a manifest, so commits are never torn, nothing comes twice when segments
are rewritten, and segments of commits that lost are never seen. A consumer holds back retention at
its position, so that nothing is missing either.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.functions.codecs import in_range, prefix_end
from tidelog.operators import mvcc
from tidelog.sources.modules import Descriptor
from tidelog.sources.store import Snapshot, Store

#: Bytes of changes that a consumer may be behind; the subscription ends beyond.
LAG_BYTES = 8 << 20


def subscribe(stream: DataFrame, lo: object, hi: object, after: int = 0) -> DataFrame:
    """(seqno, commit_seqno, op, key, value): the changes in [lo, hi) past `after`; a delete has no value."""
    _not_empty(lo, hi)
    rows = stream.where(in_range(F.col("key"), lo, hi) & (F.col("seqno") > after))
    put = F.col("kind") == 1
    return rows.select("seqno", "commit_seqno", F.when(put, "PUT").otherwise("DELETE").alias("op"), "key", F.when(put, F.col("value")).alias("value"))


def _not_empty(lo: object, hi: object) -> None:
    if lo is not None and hi is not None and not lo < hi:
        raise errors.InvalidArgument("an empty range can't be subscribed to")


class Subscription:
    """A consumer of the changes in [lo, hi) past a seqno, which poll() takes step by step."""

    def __init__(self, store: Store, lo: bytes | None = None, hi: bytes | None = None, after: int | None = None, lag_bytes: int = LAG_BYTES, consumer: str | None = None):
        _not_empty(lo, hi)
        self.store, self.lo, self.hi, self.lag_bytes = store, lo, hi, lag_bytes
        self.consumer = consumer or f"subscription-{uuid.uuid4().hex}"
        at = store.snapshot()
        self.position = at.seqno if after is None else after
        if self.position > at.seqno:
            raise errors.InvalidArgument(f"{after} is past the head {at.seqno}")
        if self.position < at.manifest.watermark:
            raise errors.Gone(f"{after} is below the watermark {at.manifest.watermark}")
        store.hold(self.consumer, self.position)
        self.ended = False

    def lag(self, at: Snapshot | None = None) -> int:
        """Bytes of keys and values that wait."""
        rows = self.store.log(at or self.store.snapshot(), self.lo, self.hi, after=self.position)
        return rows.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")).alias("n")).first().n or 0

    def poll(self) -> DataFrame:
        """The changes of the commits past the position, in seqno order. Lagged ends it."""
        if self.ended:
            raise errors.Closed("the subscription has ended")
        at = self.store.snapshot()
        if self.lag_bytes and self.lag(at) > self.lag_bytes:
            self.close()
            raise errors.Lagged(f"more than {self.lag_bytes} bytes behind at {self.position}")
        return subscribe(self.store.log(at, self.lo, self.hi, after=self.position), self.lo, self.hi, self.position).orderBy("seqno")

    def advance(self, seqno: int) -> None:
        """Says that everything up to seqno has been taken: the hold moves on."""
        if seqno < self.position:
            raise errors.InvalidArgument("a position doesn't go back")
        self.position = seqno
        self.store.hold(self.consumer, seqno)

    def take(self) -> list:
        """The rows of a poll, and the position moved past them."""
        at = self.store.snapshot()
        got = self.poll().where(F.col("seqno") <= at.seqno).collect() if at.seqno > self.position else []
        self.advance(at.seqno)
        return got

    def close(self) -> None:
        self.ended = True
        self.store.hold(self.consumer, None)


def changes(store: Store, lo: bytes | None = None, hi: bytes | None = None, after: int | None = None, polls: int = 1) -> Iterator[dict]:
    """First an ATTACHED item with the position, then PUT and DELETE items, from so many polls."""
    own = Subscription(store, lo, hi, after)
    try:
        yield {"op": "ATTACHED", "seqno": own.position, "commit_seqno": own.position, "key": None, "value": None}
        for _ in range(polls):
            for r in own.take():
                yield {"op": r.op, "seqno": r.seqno, "commit_seqno": r.commit_seqno, "key": bytes(r.key), "value": None if r.value is None else bytes(r.value)}
    finally:
        own.close()


def feed(rows: DataFrame, prefix: bytes, declared: Descriptor) -> Iterator[dict]:
    """Puts below a prefix as the events that a module declares: (seqno, key, event, error), a value that doesn't fit giving an error."""
    puts = rows.where((F.col("op") == "PUT") & in_range(F.col("key"), prefix, prefix_end(prefix))).orderBy("seqno")
    for r in puts.toLocalIterator():
        event = error = None
        try:
            event = declared.normalize(json.loads(bytes(r.value)), declared.feed_event, "event")
        except ValueError as wrong:
            error = str(wrong)
        yield {"seqno": r.seqno, "key": bytes(r.key), "event": event, "error": error}


def at_commits(changed: DataFrame, log: DataFrame) -> DataFrame:
    """changed with state_value: what its key held when its whole commit was done."""
    return mvcc.as_of(changed, log, "commit_seqno")


def query_each(store: Store, rows: DataFrame, ask: Callable[[Store, Snapshot], object]) -> Iterator[tuple[int, object]]:
    """(seqno, result) of a query for each change, over the state at its commit."""
    m = store.manifest()
    for r in rows.orderBy("seqno").toLocalIterator():
        yield r.seqno, ask(store, Snapshot(m, r.commit_seqno))


# ---- Structured Streaming -------------------------------------------------------------------

_MANIFEST = "version long, head long, previous_head long"


def run_available(store: Store, checkpoint: str, apply: Callable[[DataFrame, int], None], lo: bytes | None = None, hi: bytes | None = None, files_per_batch: int = 1000) -> None:
    """Takes the commits that there are through apply(changes in seqno order, batch id), then stops.

    The stream is that of manifests, each a file that appears whole, and the checkpoint knows
    which were taken; a batch covers the seqnos between the heads that its manifests tell. After
    a failure a batch comes again with its id and its rows: apply must know it.
    """
    _not_empty(lo, hi)

    def step(batch: DataFrame, number: int) -> None:
        span = batch.agg(F.min("previous_head").alias("a"), F.max("head").alias("b")).first()
        if span.a is None or span.a == span.b:
            return
        at = Snapshot(store.manifest(), span.b)
        apply(subscribe(store.log(at, lo, hi, after=span.a), lo, hi, span.a).orderBy("seqno"), number)

    manifests = store.spark.readStream.schema(_MANIFEST).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json").json(f"{store.path}/_commits")
    manifests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log_stream(spark, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of log files that is only ever added to, as a stream. For a store use run_available."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_once(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Takes what there is through apply(batch, id), then stops. A batch may come again after a failure with its id: apply must know it."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
