"""Transactions as data: overlays, conflict checks, ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assign_seqnos(ops: DataFrame, base: int, order: str = "ord", parts: int = 1024) -> DataFrame:
    """Contiguous seqnos in batch order (a number, unique); the batch's last is every op's commit_seqno.

    Ops are numbered within ranges of their order, and the ranges one after the other, so no
    task holds the whole batch. An empty batch stays empty.
    """
    span = ops.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).first()
    width = max(1, -(-((span.b or 0) - (span.a or 0) + 1) // parts))
    rows = ops.withColumn("_part", F.floor((F.col(order) - (span.a or 0)) / width))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(order))
    numbered = rows.withColumn("_own", own).join(F.broadcast(before), F.col("_part") == F.col("_of"))
    return numbered.withColumns({"seqno": F.lit(base) + F.col("_before") + F.col("_own"), "commit_seqno": F.lit(base + span.n)}).drop("_part", "_own", "_of", "_before")


def overlay(state: DataFrame, writes: DataFrame, order: str = "ord") -> DataFrame:
    """(key, value): a state under a transaction's own writes (key, kind, value, order); its last write of a key wins, its deletes hide."""
    own = writes.groupBy("key").agg(F.max_by(F.struct("kind", "value"), order).alias("w"))
    both = state.select("key", F.col("value").alias("base")).join(own, "key", "full_outer")
    written = F.col("w").isNotNull()
    value = F.when(written, F.when(F.col("w.kind") == 1, F.col("w.value"))).otherwise(F.col("base"))
    return both.where(~written | (F.col("w.kind") == 1)).select("key", value.alias("value"))


def conflicts(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of keys (key, snap) whose key has a version, tombstones included, past the snapshot.

    Only what came after the earliest snapshot is read, and only the keys asked for are aggregated.
    """
    least = keys.agg(F.min("snap").alias("s")).first().s
    newer = log.where(F.col("seqno") > least) if least is not None else log.where("false")
    touched = newer.join(keys.select("key").distinct(), "key", "left_semi")
    newest = touched.groupBy("key").agg(F.max("seqno").alias("newest"))
    return keys.join(newest, "key").where(F.col("newest") > F.col("snap"))


def first_committer_wins(attempts: DataFrame) -> DataFrame:
    """(key, seqno, committed) for single-key attempts (key, seqno, snap) in seqno order.

    An attempt commits if the last committed one of its key is at or below its snapshot; one
    that aborts doesn't count. The fold isn't associative, so a key's attempts meet in one
    array: its size is what one key's writers did in the batch.
    """
    turns = F.array_sort(F.collect_list(F.struct("seqno", "snap")))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<struct<seqno:bigint,committed:boolean>>").alias("out"))

    def step(s, x):
        ok = s["last"] <= x["snap"]
        done = F.struct(x["seqno"].cast("long").alias("seqno"), ok.alias("committed"))
        return F.struct(F.when(ok, x["seqno"].cast("long")).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(done)).alias("out"))

    folded = attempts.groupBy("key").agg(turns.alias("t")).select("key", F.explode(F.aggregate("t", start, step)["out"]).alias("r"))
    return folded.select("key", "r.seqno", "r.committed")


def claim(requests: DataFrame, name: str, owner: str, order: str) -> DataFrame:
    """requests with winner, and outcome: won, already (the winner again) or lost."""
    first = requests.groupBy(name).agg(F.min_by(F.struct(owner, order), order).alias("w"))
    rows = requests.join(first, name).withColumn("winner", F.col("w")[owner])
    outcome = F.when(F.col(order) == F.col("w")[order], "won").when(F.col(owner) == F.col("winner"), "already").otherwise("lost")
    return rows.withColumn("outcome", outcome).drop("w")


def transfer_fold(transfers: DataFrame, accounts: list[str], opening: int) -> DataFrame:
    """(account, balance) after transfers (ord, src, dst, amount) in order; one without funds does nothing.

    Both balances are read before either is written and the target is written last, so a
    transfer to oneself adds the amount. Order matters between all accounts, so the fold is one
    group by nature: for a ledger that one writer keeps, not for a corpus.
    """
    moves = F.array_sort(F.collect_list(F.struct("ord", "src", "dst", "amount")))
    names = F.array(*(F.lit(a) for a in accounts))
    start = F.array_repeat(F.lit(opening).cast("long"), len(accounts))

    def step(balance, m):
        src, dst = F.array_position(names, m["src"]).cast("int"), F.array_position(names, m["dst"]).cast("int")
        ok = (src > 0) & (dst > 0) & (F.get(balance, src - 1) >= m["amount"])
        moved = F.transform(balance, lambda b, i: F.when(i == dst - 1, b + m["amount"]).when(i == src - 1, b - m["amount"]).otherwise(b))
        return F.when(ok, moved).otherwise(balance)

    folded = transfers.agg(F.aggregate(moves, start, step).alias("b"))
    return folded.select(F.explode(F.arrays_zip(names.alias("account"), F.col("b").alias("balance"))).alias("r")).select("r.account", "r.balance")
