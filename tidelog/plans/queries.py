"""The registered queries of the change-log engine, each with its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import codecs
from tidelog.operators import mvcc, txn, views
from tidelog.plans.tables import EVENT_LOG, ORDERS, event_log, order_records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SNAP, LO, HI = 5000, "usr/00000020", "usr/00000090"
_STATE = "SELECT key, seqno, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS r FROM log {where}) WHERE r = 1 AND kind = 1"


def _query(sql: str | None):
    """Registers a query; one whose SQL is too slow over whole tables has none, and a test against plain loops."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scans ----------------------------------------------------------------------------------


@_query(EVENT_LOG + _STATE.format(where="WHERE seqno <= 5000"))
def snapshot_read(spark, d):
    return mvcc.latest(event_log(spark, d), SNAP)


@_query(EVENT_LOG + _STATE.format(where="WHERE key >= 'usr/00000020' AND key < 'usr/00000090'"))
def scan_range(spark, d):
    return mvcc.scan(event_log(spark, d), LO, HI)


@_query(EVENT_LOG + f"SELECT row_number() OVER (ORDER BY key DESC) AS rank, key, value FROM ({_STATE.format(where='')}) ORDER BY key DESC LIMIT 20")
def scan_reverse_topn(spark, d):
    rows = mvcc.scan(event_log(spark, d), reverse=True).limit(20)
    return rows.select(F.row_number().over(W.orderBy(F.col("key").desc())).alias("rank"), "key", "value")


@_query(EVENT_LOG + _STATE.format(where="WHERE key LIKE 'usr/0000001%'"))
def scan_prefix(spark, d):
    return mvcc.scan_prefix(event_log(spark, d), "usr/0000001")


@_query(EVENT_LOG + f"""SELECT rank, key, seqno, value, n > 10 AS has_more FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY key) AS rank
  FROM (SELECT * FROM ({_STATE.format(where="WHERE key > 'usr/00000040'")}) ORDER BY key LIMIT 11)) WHERE rank <= 10""")
def scan_page_after(spark, d):
    return mvcc.page(event_log(spark, d), 10, after="usr/00000040").drop("next_after")


@_query(EVENT_LOG + f"""SELECT rank, key, seqno, value, n > 10 AS has_more FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY key DESC) AS rank
  FROM (SELECT * FROM ({_STATE.format(where="WHERE key < 'usr/00000040' AND key >= 'usr/00000010'")}) ORDER BY key DESC LIMIT 11)) WHERE rank <= 10""")
def scan_page_reverse(spark, d):
    return mvcc.page(event_log(spark, d), 10, lo="usr/00000010", after="usr/00000040", reverse=True).drop("next_after")


@_query(EVENT_LOG + _STATE.format(where="WHERE key >= 'usr/00000090' AND key < 'usr/00000020'"))
def scan_inverted(spark, d):
    return mvcc.scan(event_log(spark, d), HI, LO)


@_query(EVENT_LOG + _STATE.format(where="WHERE key = 'usr/00000007'"))
def get_point(spark, d):
    return mvcc.get(event_log(spark, d), "usr/00000007")


@_query(EVENT_LOG + "SELECT key, max(seqno) AS seqno, arg_max(kind, seqno) AS kind FROM log GROUP BY key")
def latest_versions(spark, d):
    return mvcc.versioned(event_log(spark, d)).select("key", "seqno", "kind")


@_query(EVENT_LOG + f"SELECT count(*) AS n FROM ({_STATE.format(where='')}) WHERE key LIKE 'usr/000000%'")
def count_prefix(spark, d):
    return mvcc.scan_prefix(event_log(spark, d), "usr/000000").agg(F.count("*").alias("n"))


@_query(EVENT_LOG + """SELECT key, seqno, kind, value, row_number() OVER w AS version, lag(value) OVER w AS previous FROM log WINDOW w AS (PARTITION BY key ORDER BY seqno)""")
def version_history(spark, d):
    return mvcc.history(event_log(spark, d)).select("key", "seqno", "kind", "value", "version", "previous")


@_query(EVENT_LOG + "SELECT key, value, kind, seqno AS from_seqno, lead(seqno) OVER (PARTITION BY key ORDER BY seqno) AS to_seqno FROM log")
def validity_intervals(spark, d):
    return mvcc.validity(event_log(spark, d))


@_query(EVENT_LOG + """, v AS (SELECT *, lead(seqno) OVER (PARTITION BY key ORDER BY seqno) AS nxt FROM log)
  SELECT l.key, l.seqno, l.commit_seqno, CASE WHEN v.kind = 1 THEN v.value END AS state_value FROM log l LEFT JOIN v ON v.key = l.key AND v.seqno <= l.commit_seqno AND (v.nxt IS NULL OR v.nxt > l.commit_seqno)""")
def asof_commit_read(spark, d):
    log = event_log(spark, d)
    return mvcc.as_of(log.select("key", "seqno", "commit_seqno"), log, "commit_seqno")


@_query(EVENT_LOG + f""", o AS ({_STATE.format(where="WHERE seqno <= 5000")}), n AS ({_STATE.format(where="WHERE seqno <= 8000")})
  SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS old_value, n.value AS new_value
  FROM o FULL JOIN n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.value <> n.value""")
def snapshot_diff(spark, d):
    return mvcc.diff(event_log(spark, d), SNAP, 8000)


# ---- aggregates and example modules -----------------------------------------------------------


@_query("""SELECT l_returnflag AS prefix, count(*) AS count, CAST(sum(l_quantity) AS BIGINT) AS sum, CAST(min(l_quantity) AS BIGINT) AS min, CAST(max(l_quantity) AS BIGINT) AS max FROM lineitem GROUP BY 1""")
def agg_by_prefix(spark, d):
    n = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("prefix")).agg(F.count("*").alias("count"), F.sum(n).alias("sum"), F.min(n).alias("min"), F.max(n).alias("max"))


@_query("""SELECT count(*) AS count, count(*) AS summed, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS sum, CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR) AS min, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS max FROM lineitem WHERE l_returnflag = 'R'""")
def agg_prefix(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(codecs.decode_u64_le(codecs.encode_u64_le(F.col("l_quantity").cast("long"))).alias("n"))
    out = views.numeric_summary(rows)
    return out.select("count", "summed", *(F.col(c).cast("string").alias(c) for c in ("sum", "min", "max")))


@_query("SELECT CAST(0 AS BIGINT) AS count, CAST(0 AS BIGINT) AS summed, '0' AS sum, '18446744073709551615' AS min, '0' AS max")
def agg_empty_prefix(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'none'").select(F.col("l_quantity").cast("long").alias("n"))
    out = views.numeric_summary(rows)
    return out.select("count", "summed", *(F.col(c).cast("string").alias(c) for c in ("sum", "min", "max")))


def _stats(spark, d):
    return order_records(spark, d).groupBy("customer").agg(F.count("*").alias("orders"), F.sum("cents").alias("total"))


_STATS = ORDERS + ", s AS (SELECT customer, count(*) AS orders, CAST(sum(cents) AS BIGINT) AS total FROM recs GROUP BY 1) "
_TOP = "SELECT row_number() OVER (ORDER BY total DESC, customer) AS rank, customer, orders, total, total // orders AS average FROM s {where} ORDER BY total DESC, customer LIMIT {n}"


@_query(_STATS + _TOP.format(where="", n=10))
def top_customers(spark, d):
    return views.top_customers(_stats(spark, d))


@_query(_STATS + _TOP.format(where="WHERE orders > 0 AND total >= 200000000", n=100))
def top_customers_having(spark, d):
    return views.top_customers(_stats(spark, d), 500, 200_000_000)


@_query(EVENT_LOG + f"SELECT event_type, count(*) AS orders, CAST(sum(value) AS BIGINT) AS value FROM (SELECT key, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS r FROM log WHERE seqno <= {SNAP}) WHERE r = 1 AND kind = 1) GROUP BY 1")
def live_stats_recount(spark, d):
    rows = event_log(spark, d).where(F.col("seqno") <= SNAP).groupBy("key").agg(F.max_by(F.struct("kind", "value", "event_type"), "seqno").alias("v"))
    return rows.select("v.*").where("kind = 1").groupBy("event_type").agg(F.count("*").alias("orders"), F.sum("value").alias("value"))


@_query(EVENT_LOG + "SELECT event_type, count(*) AS orders, CAST(sum(value) AS BIGINT) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS r FROM log) WHERE r = 1 AND kind = 1 GROUP BY 1")
def live_stats_fold(spark, d):
    return views.fold(views.deltas(event_log(spark, d), "event_type", "value"), "event_type", "value")


@_query(ORDERS + "SELECT customer, id, count(*) OVER w AS orders, CAST(sum(cents) OVER w AS BIGINT) AS total, row_number() OVER w AS nth FROM recs WINDOW w AS (PARTITION BY customer ORDER BY id ROWS UNBOUNDED PRECEDING)")
def place_order_running(spark, d):
    w = W.partitionBy("customer").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    return order_records(spark, d).select("customer", "id", F.count("*").over(w).alias("orders"), F.sum("cents").over(w).alias("total"), F.row_number().over(W.partitionBy("customer").orderBy("id")).alias("nth"))


@_query(ORDERS + "SELECT 'idx/customer/' || customer || '/' || id AS key FROM recs")
def customer_index(spark, d):
    return order_records(spark, d).select(F.concat_ws("/", F.lit("idx/customer"), F.col("customer").cast("string"), F.col("id").cast("string")).alias("key"))


@_query("""SELECT 'brand' AS "index", p_brand AS value, CAST(p_partkey AS VARCHAR) AS id FROM part UNION ALL SELECT 'type', p_type, CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM part""")
def dynamic_index(spark, d):
    return views.postings(table(spark, d, "part"), "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size"})


@_query("""SELECT p_brand AS brand, count(*) AS n, CAST(round(sum(p_retailprice) * 100) AS BIGINT) AS cents FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 1) GROUP BY 1""")
def index_lookup(spark, d):
    parts = table(spark, d, "part")
    index = views.postings(parts, "p_partkey", {"brand": "p_brand"})
    wanted = parts.where("p_size = 1").select(F.col("p_brand").alias("value")).distinct()
    hits = index.join(wanted, "value", "left_semi").select(F.col("id").cast("long").alias("p_partkey"))
    rows = parts.join(hits, "p_partkey")
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice") * 100).cast("long").alias("cents"))


@_query("""SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_index_values(spark, d):
    value = codecs.index_value(F.col("props"), "k")
    return table(spark, d, "events").select("event_id", value.alias("value")).where("value IS NOT NULL")


@_query(EVENT_LOG + "SELECT 'feed/' || lpad(CAST(seqno AS VARCHAR), 20, '0') AS key, CASE WHEN kind = 1 THEN 'put' ELSE 'delete' END AS op, key AS id, CASE WHEN kind = 1 THEN value END AS record FROM log WHERE key >= 'usr/00000020' AND key < 'usr/00000090'")
def order_feed(spark, d):
    rows = event_log(spark, d).where(codecs.in_range(F.col("key"), LO, HI))
    return rows.select(F.concat(F.lit("feed/"), codecs.padded(F.col("seqno"), 20)).alias("key"), F.when(F.col("kind") == 1, "put").otherwise("delete").alias("op"), F.col("key").alias("id"), F.when(F.col("kind") == 1, F.col("value")).alias("record"))


@_query("SELECT doc_id, octet_length(encode(text)) > 4096 AS elided, CASE WHEN octet_length(encode(text)) <= 4096 THEN sha256(text) END AS inline_sha256 FROM documents")
def feed_elided(spark, d):
    rows = views.elide(table(spark, d, "documents").select("doc_id", F.col("text").alias("value")), 4096)
    return rows.select("doc_id", "elided", F.sha2("value", 256).alias("inline_sha256"))


@_query("""SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def cascade_delete(spark, d):
    children = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return views.cascade(gone, children, "l_orderkey")


@_query("""SELECT event_id, user_id % 40 AS name, first_value(user_id) OVER w AS winner, CASE WHEN event_id = first_value(event_id) OVER w THEN 'won' WHEN user_id = first_value(user_id) OVER w THEN 'already' ELSE 'lost' END AS outcome
  FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY event_id)""")
def claim_winner(spark, d):
    requests = table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") % 40).alias("name"))
    return txn.claim(requests, "name", "user_id", "event_id").select("event_id", "name", "winner", "outcome")


@_query(None)
def transfer_fold(spark, d):
    account = lambda c: F.concat(F.lit("acct/"), c.cast("string"))
    moves = table(spark, d, "events").select((F.col("event_id") + 1).alias("ord"), account(F.col("user_id") % 4).alias("src"), account(F.floor(F.col("user_id") / 4) % 4).alias("dst"), (F.col("event_id") % 700).alias("amount"))
    return txn.transfer_fold(moves, [f"acct/{k}" for k in range(4)], 1000)


# ---- transactions -----------------------------------------------------------------------------


@_query(EVENT_LOG + f""", base AS ({_STATE.format(where="WHERE seqno <= 5000")}), own AS (SELECT key, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS r FROM log WHERE seqno > 9900) WHERE r = 1)
  SELECT coalesce(own.key, base.key) AS key, CASE WHEN own.key IS NOT NULL THEN own.value ELSE base.value END AS value FROM base FULL JOIN own ON base.key = own.key WHERE own.key IS NULL OR own.kind = 1""")
def txn_overlay(spark, d):
    log = event_log(spark, d)
    return txn.overlay(mvcc.latest(log, SNAP), log.where("seqno > 9900"), "seqno")


@_query(EVENT_LOG + ", k AS (SELECT DISTINCT key, 9500 AS snap FROM log) SELECT k.key, max(seqno) AS newest FROM k JOIN log USING (key) GROUP BY k.key HAVING max(seqno) > 9500")
def occ_validate(spark, d):
    log = event_log(spark, d)
    keys = log.select("key").distinct().withColumn("snap", F.lit(9500))
    return txn.conflicts(keys, log).select("key", "newest")


@_query("""WITH RECURSIVE a AS (SELECT user_id AS key, event_id + 1 AS seqno, greatest(0, event_id + 1 - 200 - (event_id % 7) * 50) AS snap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  f AS (SELECT key, i, seqno, true AS committed, seqno AS last FROM a WHERE i = 1 UNION ALL
    SELECT a.key, a.i, a.seqno, f.last <= a.snap, CASE WHEN f.last <= a.snap THEN a.seqno ELSE f.last END FROM f JOIN a ON a.key = f.key AND a.i = f.i + 1) SELECT key, seqno, committed FROM f""")
def occ_first_committer(spark, d):
    n = F.col("event_id")
    attempts = table(spark, d, "events").select(F.col("user_id").alias("key"), (n + 1).alias("seqno"), F.greatest(F.lit(0), n + 1 - 200 - (n % 7) * 50).alias("snap"))
    return txn.first_committer_wins(attempts)


@_query("SELECT event_id, 7000 + row_number() OVER (ORDER BY event_id) AS seqno, 7000 + count(*) OVER () AS commit_seqno FROM events WHERE event_type = 'purchase'")
def batch_seqno_assign(spark, d):
    return txn.assign_seqnos(table(spark, d, "events").where("event_type = 'purchase'").select("event_id"), 7000, "event_id")


# ---- triggers and subscriptions ------------------------------------------------------------------


@_query(EVENT_LOG + "SELECT key, count(*) AS changes, max(seqno) AS last FROM log WHERE seqno > 9000 AND origin = 'user' GROUP BY key")
def trigger_touch_coalesce(spark, d):
    return views.touched(event_log(spark, d), 9000)


@_query(EVENT_LOG + "SELECT seqno, commit_seqno, kind, key, value FROM log WHERE origin = 'user' AND seqno > 9000 AND key >= 'usr/00000020' AND key < 'usr/00000090'")
def trigger_changes(spark, d):
    rows = event_log(spark, d).where(codecs.in_range(F.col("key"), LO, HI) & (F.col("seqno") > 9000) & (F.col("origin") == "user"))
    return rows.select("seqno", "commit_seqno", "kind", "key", "value").orderBy("seqno")


@_query(EVENT_LOG + """, t AS (SELECT * FROM (VALUES ('a', 'usr/00000000', 'usr/00000050', 9000, 'keys'), ('b', 'usr/00000020', 'usr/00000090', 8000, 'changes'), ('c', 'zzz', 'zzzz', 0, 'keys')) v(name, lo, hi, off, mode))
  SELECT name, CASE WHEN mode = 'keys' THEN count(DISTINCT key) ELSE count(key) END AS pending FROM t LEFT JOIN log ON origin = 'user' AND key >= lo AND key < hi AND seqno > off GROUP BY name, mode""")
def trigger_pending(spark, d):
    triggers = spark.createDataFrame([("a", "usr/00000000", "usr/00000050", 9000, "keys"), ("b", "usr/00000020", "usr/00000090", 8000, "changes"), ("c", "zzz", "zzzz", 0, "keys")], "name string, lo string, hi string, offset long, mode string")
    return views.pending(event_log(spark, d), triggers)


@_query(EVENT_LOG + "SELECT count(*) AS written, CAST(sum(CASE WHEN origin = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS captured, CAST(sum(CASE WHEN origin = 'trigger' THEN 1 ELSE 0 END) AS BIGINT) AS effects FROM log")
def trigger_no_stacking(spark, d):
    """What a trigger over everything is handed, against what was written: the effects of triggers aren't."""
    log = event_log(spark, d)
    none = F.lit(0).cast("long")
    captured = views.touched(log, 0).select(none.alias("written"), F.col("changes").alias("captured"), none.alias("effects"))
    written = log.select(F.lit(1).cast("long").alias("written"), none.alias("captured"), (F.col("origin") == "trigger").cast("long").alias("effects"))
    return written.union(captured).agg(*(F.sum(c).alias(c) for c in ("written", "captured", "effects")))


@_query(EVENT_LOG + "SELECT seqno, CASE WHEN kind = 1 THEN 'PUT' ELSE 'DELETE' END AS op, key, CASE WHEN kind = 1 THEN value END AS value FROM log WHERE seqno > 2000 AND key >= 'usr/00000020' AND key < 'usr/00000090'")
def subscribe_range(spark, d):
    rows = event_log(spark, d).where(codecs.in_range(F.col("key"), LO, HI) & (F.col("seqno") > 2000))
    return rows.select("seqno", F.when(F.col("kind") == 1, "PUT").otherwise("DELETE").alias("op"), "key", F.when(F.col("kind") == 1, F.col("value")).alias("value"))


@_query(EVENT_LOG + "SELECT commit_seqno, count(*) AS ops, min(seqno) AS first_seqno, max(seqno) AS last_seqno, count(DISTINCT key) AS keys FROM log GROUP BY 1")
def commit_boundaries(spark, d):
    return event_log(spark, d).groupBy("commit_seqno").agg(F.count("*").alias("ops"), F.min("seqno").alias("first_seqno"), F.max("seqno").alias("last_seqno"), F.count_distinct("key").alias("keys"))


@_query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def queue_orphans(spark, d):
    """Queue rows of event types as triggers; those of two no longer exist."""
    queue = table(spark, d, "events").select(F.col("event_type").alias("name"), "event_id")
    return views.orphans(queue, queue.where("name NOT IN ('view', 'click')")).select("event_id")


@_query("""WITH w AS (SELECT n_name AS name, CAST(n_regionkey % 3 AS VARCHAR) AS field FROM nation UNION ALL SELECT r_name, 'r' FROM region),
  h AS (SELECT n_name AS name, CAST(n_regionkey % 2 AS VARCHAR) AS active_field FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 'old ' || r_name, 'x' FROM region)
  SELECT coalesce(w.name, h.name) AS name, CASE WHEN h.name IS NULL THEN 'create' WHEN w.name IS NULL THEN 'drop' ELSE 'swap' END AS action, field, active_field
  FROM w FULL JOIN h ON w.name = h.name WHERE h.name IS NULL OR w.name IS NULL OR field <> active_field""")
def index_spec_changes(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    want = nation.select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 3).cast("string").alias("field")).union(region.select("r_name", F.lit("r")))
    have = nation.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2).cast("string").alias("field")).union(region.select(F.concat(F.lit("old "), "r_name"), F.lit("x")))
    return views.spec_changes(want, have)


@_query("SELECT doc_id, octet_length(encode(text)) > 4096 AS elided, sha256(text) AS value_sha256 FROM documents")
def elided_current(spark, d):
    """Changes whose long values were left out, read from the current state."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    changes = views.elide(docs.withColumn("kind", F.lit(1)), 4096)
    return views.current_values(changes, docs).select(F.col("key").alias("doc_id"), "elided", F.sha2("value", 256).alias("value_sha256"))


# ---- retention, branches, recovery, replicas --------------------------------------------------


@_query(EVENT_LOG + "SELECT key, seqno, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key, seqno <= 5000 ORDER BY seqno DESC) AS r FROM log) WHERE seqno > 5000 OR (r = 1 AND kind = 1)")
def compaction_gc(spark, d):
    return mvcc.compact(event_log(spark, d), SNAP).select("key", "seqno", "kind", "value")


@_query(EVENT_LOG + ", m AS (SELECT min(seqno) + 40 AS half FROM log) SELECT key, seqno FROM log, m WHERE kind = 0 AND seqno > half AND key NOT IN (SELECT key FROM log, m WHERE seqno <= half)")
def tombstone_drop(spark, d):
    """A young run over an old one of 41 versions; both together are the whole log."""
    log = event_log(spark, d)
    half = log.agg(F.min("seqno").alias("n")).first().n + 40
    return mvcc.droppable_tombstones(log.where(F.col("seqno") > half), log.where(F.col("seqno") <= half)).select("key", "seqno")


@_query(EVENT_LOG + _STATE.format(where="WHERE seqno <= 3333"))
def fork_at(spark, d):
    return mvcc.fork_at(event_log(spark, d), 3333)


@_query(EVENT_LOG + f""", o AS ({_STATE.format(where="WHERE seqno <= 3333")}), n AS ({_STATE.format(where="")}) SELECT CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n
  FROM o FULL JOIN n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.value <> n.value GROUP BY 1""")
def fork_divergence(spark, d):
    return mvcc.diff(event_log(spark, d), 3333, 1 << 56).groupBy("change").agg(F.count("*").alias("n"))


@_query(EVENT_LOG + f"{_STATE.format(where='')}")
def journal_rebuild(spark, d):
    log = event_log(spark, d)
    return mvcc.rebuild(mvcc.fork_at(log, 4000), log.where("seqno > 4000"))


@_query(EVENT_LOG + "SELECT b AS after_seqno, seqno AS next_seqno FROM (SELECT seqno, lag(seqno) OVER (ORDER BY seqno) AS b FROM log WHERE event_type <> 'signup') WHERE seqno - b > 1")
def journal_gap_check(spark, d):
    return mvcc.gaps(event_log(spark, d).where("event_type <> 'signup'"))


@_query(EVENT_LOG + _STATE.format(where="WHERE key >= 'usr/00000030' AND key < 'usr/00000060'"))
def edge_scope_scan(spark, d):
    lo, hi = mvcc.clamp(F.lit("usr/00000010"), F.lit("usr/00000060"), "usr/00000030", "usr/00000090")
    return mvcc.latest(event_log(spark, d).where((F.col("key") >= lo) & (F.col("key") < hi)))


@_query(EVENT_LOG + _STATE.format(where="WHERE key >= 'usr/00000020' AND key < 'usr/00000090'"))
def edge_overlay(spark, d):
    log = event_log(spark, d).where(codecs.in_range(F.col("key"), LO, HI))
    return mvcc.overlay(log.where("seqno <= 6000"), log.where("seqno > 5500"), 6000)


@_query(EVENT_LOG + ", s AS (SELECT (seqno - 1) // 1000 AS segment, min(key) AS mink, max(key) AS maxk, count(*) AS n FROM log GROUP BY 1) SELECT segment, n FROM s WHERE maxk >= 'usr/00000020' AND mink < 'usr/00000025'")
def slice_overlap(spark, d):
    files = event_log(spark, d).groupBy(F.floor((F.col("seqno") - 1) / 1000).alias("segment")).agg(F.min("key").alias("mink"), F.max("key").alias("maxk"), F.count("*").alias("n"))
    return files.where((F.col("maxk") >= "usr/00000020") & (F.col("mink") < "usr/00000025")).select("segment", "n")


@_query(EVENT_LOG + ", f AS (SELECT (seqno - 1) // 1000 AS file, count(*) AS size, sum(CASE WHEN nxt IS NULL AND kind = 1 THEN 1 ELSE 0 END) AS alive FROM (SELECT *, lead(seqno) OVER (PARTITION BY key ORDER BY seqno) AS nxt FROM log) GROUP BY 1) SELECT file, size, CAST(size - alive AS BIGINT) AS dead, CAST(size - alive AS DOUBLE) / size AS ratio FROM f WHERE CAST(size - alive AS DOUBLE) / size >= 0.5")
def gc_victim_ratio(spark, d):
    log = event_log(spark, d)
    file = F.floor((F.col("seqno") - 1) / 1000).alias("file")
    live = mvcc.latest(log).select(file, F.lit(1).cast("long").alias("bytes"))
    return views.gc_candidates(log.groupBy(file).agg(F.count("*").alias("size")), live, 0.5)


@_query(EVENT_LOG + "SELECT (seqno - 1) // 1000 AS file, count(*) AS rows FROM (SELECT *, lead(seqno) OVER (PARTITION BY key ORDER BY seqno) AS nxt FROM log) WHERE nxt IS NOT NULL OR kind = 0 GROUP BY 1")
def gc_garbage_rows(spark, d):
    return mvcc.garbage(event_log(spark, d)).groupBy(F.floor((F.col("seqno") - 1) / 1000).alias("file")).agg(F.count("*").alias("rows"))


@_query(EVENT_LOG + "SELECT CASE WHEN seqno <= 2500 THEN 0 WHEN seqno <= 5000 THEN 1 ELSE 2 END AS level, count(*) AS entries, count(DISTINCT key) AS keys, CAST(sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, min(seqno) AS min_seqno, max(seqno) AS max_seqno FROM log GROUP BY 1")
def stats_levels(spark, d):
    level = F.when(F.col("seqno") <= 2500, 0).when(F.col("seqno") <= 5000, 1).otherwise(2)
    return event_log(spark, d).groupBy(level.alias("level")).agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"), F.count_if(F.col("kind") == 0).alias("tombstones"), F.min("seqno").alias("min_seqno"), F.max("seqno").alias("max_seqno"))


# ---- codecs ---------------------------------------------------------------------------------------


@_query("SELECT doc_id, octet_length(encode(text)) AS len, sha256(base64(encode(text))) AS base64_sha256, upper(hex(encode(text[1:8]))) AS head_hex FROM documents")
def bytes_encodings(spark, d):
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.octet_length(raw).cast("long").alias("len"), F.sha2(codecs.to_base64(raw), 256).alias("base64_sha256"), F.hex(F.substring("text", 1, 8).cast("binary")).alias("head_hex"))


@_query("SELECT o_orderkey, o_orderkey AS decoded, lpad(hex(o_orderkey), 16, '0') AS big_endian FROM orders")
def u64_codec(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", codecs.decode_u64_le(codecs.encode_u64_le(n)).cast("long").alias("decoded"), F.hex(codecs.encode_u64_be(n)).alias("big_endian"))


@_query("SELECT n_name, '\"' || n_name || '\"' AS shown FROM nation")
def key_display(spark, d):
    return table(spark, d, "nation").select("n_name", codecs.display_key(F.col("n_name")).alias("shown"))


@_query("SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS segment, o_orderkey % 3 = 0 AS other FROM orders")
def key_segments(spark, d):
    rows = order_records(spark, d)
    key = F.when(F.col("id") % 3 == 0, F.concat("key", F.lit("/line"))).otherwise(F.col("key"))
    return rows.select(F.col("id").alias("o_orderkey"), codecs.key_segment(key, "orders/", r"\d{8}").alias("segment"), (codecs.key_segment(key, "lines/").isNull() & key.contains("/line")).alias("other"))


@_query("SELECT doc_id, sha256(text) AS from_base64, sha256(text) AS from_hex, true AS refused FROM documents WHERE text <> ''")
def bytes_decoding(spark, d):
    """Base64 and hex read back; what isn't of their form is refused."""
    raw = F.col("text").cast("binary")
    b64, digits = codecs.to_base64(raw), F.hex(raw)
    refused = codecs.parse_base64(F.concat(F.lit("!"), b64)).isNull() & codecs.parse_hex(F.concat(digits, F.lit("a"))).isNull()
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2(codecs.parse_base64(b64), 256).alias("from_base64"), F.sha2(codecs.parse_hex(digits), 256).alias("from_hex"), refused.alias("refused"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
