"""Reads over a change log: a DataFrame (key, seqno, commit_seqno, kind, value[, origin]).

kind is 1 for a put and 0 for a delete. The state at a seqno is, for each key, the newest
version at or below it, deletes hidden; one partially aggregated max per key finds it, no sort.
Filters on key and seqno stay plain predicates: over stored segments they reach the Parquet scan,
over a log that is derived from other tables they don't. `latest` gives a state without order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument
from tidelog.functions.codecs import in_range, prefix_end, text_prefix_end


def versioned(log: DataFrame, seqno: int | None = None) -> DataFrame:
    """(key, seqno, commit_seqno, kind, value): the newest version of each key, tombstones included."""
    rows = log if seqno is None else log.where(F.col("seqno") <= seqno)
    newest = F.max_by(F.struct("seqno", "commit_seqno", "kind", "value"), "seqno")
    return rows.groupBy("key").agg(newest.alias("v")).select("key", "v.*")


def latest(log: DataFrame, seqno: int | None = None) -> DataFrame:
    """(key, seqno, value): the state at seqno."""
    return versioned(log, seqno).where("kind = 1").select("key", "seqno", "value")


def scan(log: DataFrame, lo: object = None, hi: object = None, seqno: int | None = None, reverse: bool = False) -> DataFrame:
    """The state of [lo, hi) in key order; an empty or inverted range is empty."""
    rows = latest(log.where(in_range(F.col("key"), lo, hi)), seqno)
    return rows.orderBy(F.col("key").desc() if reverse else F.col("key").asc())


def scan_prefix(log: DataFrame, prefix: str | bytes, seqno: int | None = None, reverse: bool = False) -> DataFrame:
    hi = text_prefix_end(prefix) if isinstance(prefix, str) else prefix_end(prefix)
    return scan(log, prefix if prefix else None, hi, seqno, reverse)


def get(log: DataFrame, key: object, seqno: int | None = None) -> DataFrame:
    """The state of one key: a row or none."""
    return latest(log.where(F.col("key") == F.lit(key)), seqno)


def page(log: DataFrame, limit: int, lo: object = None, hi: object = None, after: object = None, reverse: bool = False, seqno: int | None = None, most: int = 10_000) -> DataFrame:
    """(rank, key, seqno, value, has_more, next_after): limit rows strictly past the cursor `after`; next_after, the last key, only if there are more."""
    if not 1 <= limit <= most:
        raise InvalidArgument(f"limit is 1 to {most}")
    rows = log.where(in_range(F.col("key"), lo, hi))
    if after is not None:
        rows = rows.where(F.col("key") < F.lit(after) if reverse else F.col("key") > F.lit(after))
    order = F.col("key").desc() if reverse else F.col("key").asc()
    some = latest(rows, seqno).orderBy(order).limit(limit + 1)
    ranked = some.withColumn("rank", F.row_number().over(W.orderBy(order)))
    ranked = ranked.withColumn("has_more", F.max("rank").over(W.partitionBy()) > limit)
    ranked = ranked.withColumn("next_after", F.when(F.col("has_more"), F.max(F.when(F.col("rank") == limit, F.col("key"))).over(W.partitionBy())))
    return ranked.where(F.col("rank") <= limit).select("rank", "key", "seqno", "value", "has_more", "next_after")


def _by_key() -> W:
    return W.partitionBy("key").orderBy("seqno")


def history(log: DataFrame) -> DataFrame:
    """Every version with its predecessor's value, and the number of the version."""
    w = _by_key()
    return log.withColumns({"version": F.row_number().over(w), "previous": F.lag("value").over(w), "previous_kind": F.lag("kind").over(w)})


def validity(log: DataFrame) -> DataFrame:
    """(key, value, kind, from_seqno, to_seqno): versions as half-open intervals, the last open."""
    return log.select("key", "value", "kind", F.col("seqno").alias("from_seqno"), F.lead("seqno").over(_by_key()).alias("to_seqno"))


def as_of(events: DataFrame, log: DataFrame, at: str) -> DataFrame:
    """events (with key and the seqno column `at`) with state_value: the key's value as of then.

    Both sides are merged by key and order, and the newest version is carried forward: one
    shuffle and one sort, where an interval join would compare every event with every version.
    """
    extra = [c for c in events.columns if c not in ("key", at)]
    marks = events.select("key", F.col(at).alias("__at"), F.lit(1).alias("__event"), F.struct(*extra).alias("__row"), F.lit(None).cast(log.schema["value"].dataType).alias("__value"), F.lit(None).cast("int").alias("__kind"))
    row_type = marks.schema["__row"].dataType
    versions = log.select("key", F.col("seqno").alias("__at"), F.lit(0).alias("__event"), F.lit(None).cast(row_type).alias("__row"), F.col("value").alias("__value"), F.col("kind").cast("int").alias("__kind"))
    w = W.partitionBy("key").orderBy("__at", "__event").rowsBetween(W.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("__event") == 0, F.struct("__kind", "__value")), ignorenulls=True).over(w)
    merged = marks.union(versions).withColumn("__state", carried).where("__event = 1")
    return merged.select("key", F.col("__at").alias(at), "__row.*", F.when(F.col("__state")["__kind"] == 1, F.col("__state")["__value"]).alias("state_value"))


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """(key, change, old_value, new_value) between two states; only keys touched in between are read twice."""
    before = F.max_by(F.when(F.col("kind") == 1, F.col("value")), F.when(F.col("seqno") <= old, F.col("seqno")))
    after = F.max_by(F.when(F.col("kind") == 1, F.col("value")), F.col("seqno"))
    rows = log.where(F.col("seqno") <= new).groupBy("key").agg(before.alias("old_value"), after.alias("new_value"), F.max("seqno").alias("last"))
    rows = rows.where(F.col("last") > old)
    change = F.when(F.col("old_value").isNull() & F.col("new_value").isNotNull(), "added").when(F.col("old_value").isNotNull() & F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed")
    return rows.withColumn("change", change).where("change IS NOT NULL").select("key", "change", "old_value", "new_value")


# ---- retention ------------------------------------------------------------------------------


def compact(log: DataFrame, watermark: int) -> DataFrame:
    """What a full rewrite keeps: all above the watermark and each key's newest at or below it, unless that is a tombstone."""
    below = F.col("seqno") <= watermark
    newest = F.max(F.when(below, F.col("seqno"))).over(W.partitionBy("key"))
    keep = ~below | ((F.col("seqno") == newest) & (F.col("kind") == 1))
    return log.withColumn("__keep", keep).where("__keep").drop("__keep")


def garbage(log: DataFrame) -> DataFrame:
    """The versions whose values no read of the head needs: all but those that the state points at, by key and seqno."""
    return log.join(latest(log).select("key", "seqno"), ["key", "seqno"], "left_anti")


def watermark(head: int, *holds: int) -> int:
    return min(holds, default=head + 1)


def fork_at(log: DataFrame, seqno: int) -> DataFrame:
    """A branch's base: the state at seqno, tombstones left out."""
    return latest(log, seqno)


def droppable_tombstones(run: DataFrame, older: DataFrame) -> DataFrame:
    """Tombstones of a run whose key no older run may hold."""
    return run.where("kind = 0").join(older.select("key").distinct(), "key", "left_anti")


def rebuild(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state from a base (key, seqno, value) and the changes after it."""
    rows = base.select("key", "seqno", F.col("seqno").alias("commit_seqno"), F.lit(1).alias("kind"), "value")
    return latest(rows.unionByName(deltas.select("key", "seqno", "commit_seqno", F.col("kind").cast("int").alias("kind"), "value")))


def gaps(log: DataFrame, parts: int = 1024) -> DataFrame:
    """(after_seqno, next_seqno) wherever seqnos aren't contiguous.

    Looks within ranges of seqnos, then across the ranges' ends (a row a range).
    """
    span = log.agg(F.min("seqno").alias("a"), F.max("seqno").alias("b")).first()
    if span.a is None:
        return log.select(F.col("seqno").alias("after_seqno"), F.col("seqno").alias("next_seqno")).limit(0)
    width = max(1, -(-(span.b - span.a + 1) // parts))
    rows = log.select("seqno", F.floor((F.col("seqno") - span.a) / width).alias("part"))
    inner = rows.withColumn("before", F.lag("seqno").over(W.partitionBy("part").orderBy("seqno"))).where(F.col("seqno") - F.col("before") > 1)
    ends = rows.groupBy("part").agg(F.min("seqno").alias("lo"), F.max("seqno").alias("hi"))
    across = ends.withColumn("before", F.lag("hi").over(W.orderBy("part"))).where(F.col("lo") - F.col("before") > 1)
    return inner.select(F.col("before").alias("after_seqno"), F.col("seqno").alias("next_seqno")).union(across.select("before", "lo"))


def clamp(lo: Column, hi: Column, scope_lo: object, scope_hi: object) -> tuple[Column, Column]:
    """A range narrowed to a replica's scope."""
    return F.greatest(lo, F.lit(scope_lo)), F.least(hi, F.lit(scope_hi))


def in_scope(key: bytes, scope_lo: bytes | None, scope_hi: bytes | None) -> bytes:
    """key, or InvalidArgument if a replica of that scope can't know it."""
    if (scope_lo is not None and key < scope_lo) or (scope_hi is not None and key >= scope_hi):
        raise InvalidArgument("the key is outside the replica's scope")
    return key


def overlay(slice_: DataFrame, stream: DataFrame, flushed: int) -> DataFrame:
    """A replica's state: its slice under the stream changes past the slice's flushed seqno."""
    return latest(slice_.unionByName(stream.where(F.col("seqno") > flushed)))
