"""Aggregates, indexes, feeds and incrementally kept views over a change log or a state."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.codecs import U64


def numeric_summary(values: DataFrame, column: str = "n") -> DataFrame:
    """One row: count of all rows, and of the numbers how many, sum mod 2^64, min and max (of none: 2^64 - 1 and 0)."""
    n = F.col(column).cast("decimal(20,0)")
    total = F.coalesce(F.sum(n.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) % F.lit(Decimal(U64)).cast("decimal(38,0)")
    return values.agg(
        F.count("*").alias("count"), F.count(n).alias("summed"), total.cast("decimal(20,0)").alias("sum"),
        F.coalesce(F.min(n), F.lit(Decimal(U64 - 1))).alias("min"), F.coalesce(F.max(n), F.lit(0).cast("decimal(20,0)")).alias("max"),
    )


def top_customers(stats: DataFrame, limit: int = 10, least: int = 0) -> DataFrame:
    """(rank, customer, orders, total, average): by total down, then name; limit up to 100, none below 1."""
    limit = max(0, min(limit, 100))
    rows = stats.where((F.col("orders") > 0) & (F.col("total") >= least)).orderBy(F.col("total").desc(), F.col("customer").asc()).limit(limit)
    rank = F.row_number().over(W.orderBy(F.col("total").desc(), F.col("customer").asc()))
    return rows.select(rank.alias("rank"), "customer", "orders", "total", F.expr("total div orders").alias("average"))


def deltas(log: DataFrame, group: str, amount: str) -> DataFrame:
    """(group, orders, amount): what each change of a record takes from its old group and adds to its new one.

    log has key, seqno, kind and the record's group and amount; the old record is the one before by seqno.
    """
    w = W.partitionBy("key").orderBy("seqno")
    old = F.lag(F.struct("kind", group, amount)).over(w)
    rows = log.withColumn("__old", old)
    minus = rows.where(F.col("__old.kind") == 1).select(F.col(f"__old.{group}").alias(group), F.lit(-1).alias("orders"), (-F.col(f"__old.{amount}")).alias(amount))
    plus = rows.where("kind = 1").select(group, F.lit(1).alias("orders"), amount)
    return minus.union(plus)


def fold(changes: DataFrame, group: str, amount: str) -> DataFrame:
    """The view that the deltas add up to; groups without records are gone, one with fewer than none fails the query."""
    rows = changes.groupBy(group).agg(F.sum("orders").cast("long").alias("orders"), F.sum(amount).cast("long").alias(amount))
    sound = F.when(F.col("orders") < 0, F.raise_error(F.concat(F.lit("a group has fewer records than none: "), F.col(group).cast("string")))).otherwise(F.col("orders"))
    return rows.withColumn("orders", sound.cast("long")).where("orders > 0")


def postings(records: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(index, value, id): for each index name and field one posting a record, none for values that can't be indexed."""
    entries = F.array(*(F.struct(F.lit(n).alias("index"), F.col(f).cast("string").alias("value")) for n, f in fields.items()))
    rows = records.select(F.explode(entries).alias("e"), F.col(id_col).cast("string").alias("id")).select("e.*", "id")
    return rows.where((F.col("value") != "") & (F.octet_length("value") <= 128) & ~F.col("value").contains("/"))


def elide(changes: DataFrame, cap: int, value: str = "value") -> DataFrame:
    """value only up to cap bytes, and whether it was left out."""
    long = F.octet_length(value) > cap
    return changes.withColumns({"elided": F.coalesce(long, F.lit(False)), value: F.when(~long, F.col(value))})


def touched(log: DataFrame, after: int) -> DataFrame:
    """(key, changes, last): keys that a keys-mode trigger would be handed past its offset."""
    return log.where((F.col("seqno") > after) & (F.col("origin") == "user")).groupBy("key").agg(F.count("*").alias("changes"), F.max("seqno").alias("last"))


def pending(log: DataFrame, triggers: DataFrame) -> DataFrame:
    """(name, pending): rows in each trigger's range [lo, hi) past its offset; coalesced by key in keys mode.

    Triggers are few and named by people: their ranges become one array in the plan, and each
    log row is tried against it, so that there is no join of ranges.
    """
    few = triggers.select("name", "lo", "hi", "offset", "mode").collect()
    if not few:
        return triggers.select("name", F.lit(0).cast("long").alias("pending"))
    key, seqno = F.col("key"), F.col("seqno")
    hit = F.array(*(F.when((key >= F.lit(t.lo)) & (key < F.lit(t.hi)) & (seqno > t.offset), F.lit(k)) for k, t in enumerate(few)))
    rows = log.where("origin = 'user'").select("key", F.explode(F.array_compact(hit)).alias("t"))
    # distinct keys are counted from one row a trigger and key
    by_key = rows.groupBy("t", "key").agg(F.count("*").alias("n")).groupBy("t").agg(F.count("*").alias("keys"), F.sum("n").alias("changes"))
    names = triggers.sparkSession.createDataFrame([(k, t.name, t.mode) for k, t in enumerate(few)], "t int, name string, mode string")
    n = F.coalesce(F.when(F.col("mode") == "keys", F.col("keys")).otherwise(F.col("changes")), F.lit(0))
    return names.join(by_key, "t", "left").select("name", n.cast("long").alias("pending"))


def orphans(queue: DataFrame, triggers: DataFrame) -> DataFrame:
    """Rows of a queue (name, ...) whose trigger no longer exists."""
    return queue.join(triggers.select("name").distinct(), "name", "left_anti")


def spec_changes(desired: DataFrame, active: DataFrame) -> DataFrame:
    """(name, action, field, active_field) of index specs (name, field): create, drop or swap; equal ones are left out."""
    both = desired.select("name", "field").join(active.select("name", F.col("field").alias("active_field")), "name", "full_outer")
    action = F.when(F.col("active_field").isNull(), "create").when(F.col("field").isNull(), "drop").when(F.col("field") != F.col("active_field"), "swap")
    return both.withColumn("action", action).where("action IS NOT NULL").select("name", "action", "field", "active_field")


def current_values(changes: DataFrame, state: DataFrame) -> DataFrame:
    """changes (key, kind, value, elided) with the values that were left out read from the current state (key, value)."""
    now = state.select(F.col("key").alias("_key"), F.col("value").alias("_now"))
    rows = changes.join(now, (F.col("key") == F.col("_key")) & F.col("elided"), "left")
    return rows.withColumn("value", F.when(F.col("elided"), F.col("_now")).otherwise(F.col("value"))).drop("_key", "_now")


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """children without those of the deleted parents."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def gc_candidates(files: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """(file, size, dead, ratio) of value files (file, size), worst first, that are dead by `least` or more; live: (file, bytes)."""
    kept = live.groupBy("file").agg(F.sum("bytes").alias("alive"))
    rows = files.join(kept, "file", "left").withColumn("dead", F.col("size") - F.coalesce("alive", F.lit(0)))
    return rows.withColumn("ratio", F.col("dead") / F.col("size")).where(F.col("ratio") >= least).select("file", "size", "dead", "ratio").orderBy(F.col("ratio").desc(), "file")
