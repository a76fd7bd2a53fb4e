"""Queries that run on a store made from the tables: commits, transactions, triggers, branches, journals and replicas."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.api import frames
from tidelog.api.facade import Api, Instances
from tidelog.functions import codecs
from tidelog.plans.tables import EVENT_LOG, ORDERS, event_log, order_records, table
from tidelog.sources.examples import EXAMPLES
from tidelog.sources.store import DELETE, PUT, Store, Txn
from tidelog.streaming import journal, subscriptions
from tidelog.streaming.replica import Replica

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LO, HI = b"usr/00000020", b"usr/00000090"
_STATE = "SELECT key, seqno, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS r FROM log {where}) WHERE r = 1 AND kind = 1"
_RANGE = "key >= 'usr/00000020' AND key < 'usr/00000090'"
#: Events of one step, where a whole table is drained.
STEP = 1 << 30


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; in local mode without one, on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stores/{uuid.uuid4().hex}"


_MADE: dict[tuple[str, str], str] = {}


def _ops(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    return log.select((F.col("seqno") - 1).alias("ord"), "kind", F.col("key").cast("binary").alias("key"), F.when(F.col("kind") == 1, F.col("value").cast("string")).cast("binary").alias("value"))


def _store(spark: SparkSession, d: str) -> Store:
    """The users' log as a store of four commits, made once; whoever writes takes a branch of it."""
    made = (spark.sparkContext.applicationId, d)
    if made not in _MADE:
        _MADE[made] = _written(spark, d, 4).path
    return Store(spark, _MADE[made])


def _written(spark: SparkSession, d: str, commits: int) -> Store:
    store = Store.create(spark, _folder(spark), "events")
    ops = _ops(spark, d)
    n = ops.count()
    for k in range(commits):
        store.write_frame(ops.where((F.col("ord") >= n * k // commits) & (F.col("ord") < n * (k + 1) // commits)))
    return store


def _branch(spark: SparkSession, d: str) -> Store:
    return _store(spark, d).fork(f"b{uuid.uuid4().hex[:12]}", _folder(spark))


def _empty(spark: SparkSession) -> Store:
    return Store.create(spark, _folder(spark), "made")


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    """key as text, and the value as a number."""
    return rows.select(F.col("key").cast("string").alias("key"), *more, F.col("value").cast("string").cast("long").alias("value"))


def _seqno(store: Store, wanted: int) -> int:
    """A seqno of the scenario, which a small table may not reach."""
    return min(wanted, store.seqno())


# ---- reads ----------------------------------------------------------------------------------


@_query(EVENT_LOG + _STATE.format(where=""))
def store_scan(spark, d):
    return _shown(_store(spark, d).scan(), "seqno")


@_query(EVENT_LOG + _STATE.format(where="WHERE seqno <= 5000"))
def store_scan_at_snapshot(spark, d):
    store = _store(spark, d)
    return _shown(store.scan(at=store.snapshot_at(_seqno(store, 5000))), "seqno")


@_query(EVENT_LOG + f"SELECT key, value FROM ({_STATE.format(where='WHERE seqno <= 6000')}) WHERE key IN ('usr/00000003', 'usr/00000007', 'usr/00000011', 'usr/99999999')")
def store_get_at_snapshot(spark, d):
    store = _store(spark, d)
    at = store.snapshot_at(_seqno(store, 6000))
    keys = [b"usr/00000003", b"usr/00000007", b"usr/00000011", b"usr/99999999"]
    rows = [(k.decode(), int(v)) for k in keys if (v := store.get(k, at)) is not None]
    return spark.createDataFrame(rows, "key string, value long")


@_query(EVENT_LOG + f"SELECT key, value FROM ({_STATE.format(where='')}) WHERE key LIKE 'usr/0000001%' ORDER BY key DESC LIMIT 5")
def store_prefix_reverse(spark, d):
    return _shown(_store(spark, d).scan_prefix(b"usr/0000001", reverse=True).limit(5))


@_query(EVENT_LOG + f"SELECT key, value, n > 12 AS has_more FROM (SELECT *, count(*) OVER () AS n FROM (SELECT * FROM ({_STATE.format(where=f'WHERE {_RANGE}')}) WHERE key < 'usr/00000071' ORDER BY key DESC LIMIT 13)) ORDER BY key DESC LIMIT 12")
def store_page(spark, d):
    pairs, more = Api(_store(spark, d)).page(lo=LO, hi=HI, after=b"usr/00000071", reverse=True, limit=12)
    return spark.createDataFrame([(k.decode(), int(v), more) for k, v in pairs], "key string, value long, has_more boolean")


@_query(EVENT_LOG + f"SELECT key, value FROM ({_STATE.format(where=f'WHERE {_RANGE}')}) ORDER BY key LIMIT 25")
def store_frames_scan(spark, d):
    """A page through the binary protocol."""
    ask = frames.frame(7, frames.OPS["SCAN"], b"\x00" + frames.maybe(LO) + frames.maybe(HI) + frames.maybe(None) + (25).to_bytes(4, "little"))
    ((request, code, payload),) = frames.frames(ask)
    ((_, status, out),) = frames.frames(frames.Server(Api(_store(spark, d))).answer(request, code, payload))
    if status != frames.STATUS["OK"]:
        raise errors.Corruption(f"status {status}")
    read = frames.Reader(out)
    rows = [(read.blob().decode(), int(read.blob())) for _ in range(read.number(4))]
    return spark.createDataFrame(rows, "key string, value long")


@_query(EVENT_LOG + f"SELECT key, seqno, kind, value FROM (SELECT key, seqno, kind, CASE WHEN kind = 1 THEN value END AS value FROM log WHERE {_RANGE} AND seqno > 2000 AND seqno <= 9000)")
def store_versions(spark, d):
    store = _store(spark, d)
    return _shown(store.log(store.snapshot_at(_seqno(store, 9000)), LO, HI, after=2000), "seqno", "kind")


@_query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(min(event_id) + 1 AS BIGINT) AS min_seqno, CAST(max(event_id) + 1 AS BIGINT) AS max_seqno, CAST(0 AS BIGINT) AS damaged FROM events")
def store_stats(spark, d):
    store = _store(spark, d)
    whole = store.stats().agg(F.sum("rows").alias("rows"), F.min("min_seqno").alias("min_seqno"), F.max("max_seqno").alias("max_seqno"))
    return whole.withColumn("damaged", F.lit(store.damaged().count()).cast("long"))


# ---- transactions -----------------------------------------------------------------------------


@_query(EVENT_LOG + f"SELECT key, value FROM ({_STATE.format(where=f'WHERE {_RANGE}')}) WHERE key NOT IN ('usr/00000021', 'usr/00000022', 'usr/00000030') UNION ALL SELECT 'usr/00000021', 77 UNION ALL SELECT 'usr/000000300', 5 UNION ALL SELECT 'usr/00000030', 9")
def store_txn_scan(spark, d):
    txn = _store(spark, d).begin()
    txn.put(b"usr/00000021", b"76")
    txn.put(b"usr/00000021", b"77")
    txn.delete(b"usr/00000022")
    txn.put(b"usr/000000300", b"5")
    txn.delete(b"usr/00000030")
    txn.put(b"usr/00000030", b"9")
    return _shown(txn.scan(LO, HI))


_TRIED = [f"usr/{k:08}" for k in (1, 5, 17, 40, 77, 149)]


@_query(EVENT_LOG + f"SELECT key, CASE WHEN max(seqno) > least(9950, (SELECT max(seqno) FROM log)) THEN 'conflict' ELSE 'committed' END AS outcome FROM log WHERE key IN ({', '.join(repr(k) for k in _TRIED)}) GROUP BY key")
def store_commit_validation(spark, d):
    """Transactions of one key each, begun at one snapshot."""
    store = _branch(spark, d)
    rows = []
    parent = _store(spark, d)
    at = parent.snapshot_at(_seqno(parent, 9950))
    written = store.log().where(F.col("key").isin([k.encode() for k in _TRIED]))
    for key in sorted({bytes(r.key).decode() for r in written.select("key").distinct().collect()}):
        txn = Txn(store, at)
        txn.put(key.encode(), b"1")
        try:
            txn.commit()
            rows.append((key, "committed"))
        except errors.Conflict:
            rows.append((key, "conflict"))
    return spark.createDataFrame(rows, "key string, outcome string")


@_query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS VARCHAR) AS id, lower(replace(r_name, ' ', '_')) AS customer, CAST((r_regionkey + 1) * 100 AS VARCHAR) AS cents FROM region")
def store_place_orders(spark, d):
    """An execution for each region, one after the other; ids are given out in turn."""
    store = _empty(spark)
    store.install("placeOrder", EXAMPLES["placeOrder"])
    regions = table(spark, d, "region").orderBy("r_regionkey").collect()
    out = [store.execute("placeOrder", {"customer": r.r_name.lower().replace(" ", "_"), "amountCents": (r.r_regionkey + 1) * 100}) for r in regions]
    return spark.createDataFrame([(o["id"], o["customer"], o["customerTotalCents"]) for o in out], "id string, customer string, cents string")


@_query("SELECT r_name AS owner, CASE WHEN r_regionkey < 2 THEN 'won' ELSE 'taken' END AS outcome FROM region")
def store_claims(spark, d):
    store = _empty(spark)
    store.install("claim", EXAMPLES["claim"])
    rows = []
    for r in table(spark, d, "region").orderBy("r_regionkey").collect():
        try:
            store.execute("claim", {"username": f"name{r.r_regionkey % 2}", "owner": r.r_name})
            rows.append((r.r_name, "won"))
        except errors.GuestFailed:
            rows.append((r.r_name, "taken"))
    return spark.createDataFrame(rows, "owner string, outcome string")


# ---- modules --------------------------------------------------------------------------------


@_query("SELECT count(*) AS count, count(*) AS summed, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS sum, CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR) AS min, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS max FROM lineitem")
def store_agg_module(spark, d):
    store = _empty(spark)
    store.install("agg", EXAMPLES["agg"])
    rows = table(spark, d, "lineitem").withColumn("n", F.monotonically_increasing_id())
    key = F.concat(F.lit("metric/"), codecs.padded(F.col("n"), 20)).cast("binary")
    store.write_frame(rows.select(F.col("n").alias("ord"), F.lit(PUT).alias("kind"), key.alias("key"), codecs.encode_u64_le(F.col("l_quantity").cast("long")).alias("value")))
    out = store.query("agg", {"prefix": "metric/"})
    return spark.createDataFrame([(out["count"], out["summed"], str(out["sum"]), str(out["min"]), str(out["max"]))], "count long, summed long, sum string, min string, max string")


@_query(ORDERS + ", s AS (SELECT customer, count(*) AS orders, CAST(sum(cents) AS BIGINT) AS total FROM recs GROUP BY 1) SELECT 'c' || customer AS customer, CAST(orders AS VARCHAR) AS orders, CAST(total AS VARCHAR) AS total, CAST(total // orders AS VARCHAR) AS average FROM s ORDER BY s.total DESC, 'c' || s.customer LIMIT 20")
def store_top_customers_module(spark, d):
    store = _empty(spark)
    store.install("topCustomers", EXAMPLES["topCustomers"])
    stats = order_records(spark, d).groupBy("customer").agg(F.count("*").alias("orders"), F.sum("cents").alias("totalCents"))
    value = codecs.json_object(orders=F.col("orders"), totalCents=F.col("totalCents"))
    store.write_frame(stats.select(F.col("customer").alias("ord"), F.lit(PUT).alias("kind"), F.concat(F.lit("customers/c"), F.col("customer")).cast("binary").alias("key"), value.cast("binary").alias("value")))
    out = Api(store).field("topCustomers", limit=20)
    return spark.createDataFrame([(o["customer"], o["orders"], o["totalCents"], o["avgCents"]) for o in out], "customer string, orders string, total string, average string")


# ---- triggers -------------------------------------------------------------------------------


def _orders_store(spark: SparkSession, d: str, module: str, prefix: str, value, width: int = 8) -> Store:
    """Orders, written behind a trigger on their prefix."""
    store = _empty(spark)
    store.install(module, EXAMPLES[module])
    store.create_trigger("t", prefix.encode(), codecs.prefix_end(prefix.encode()), module=module)
    rows = order_records(spark, d)
    store.write_frame(rows.select(F.col("id").alias("ord"), F.lit(PUT).alias("kind"), F.concat(F.lit(prefix), codecs.padded(F.col("id"), width)).cast("binary").alias("key"), value.cast("binary").alias("value")))
    return store


@_query(ORDERS + "SELECT CAST(customer AS VARCHAR) AS customer, count(*) AS orders, CAST(sum(cents) AS BIGINT) AS cents FROM recs GROUP BY 1")
def store_live_stats(spark, d):
    """Statistics that a trigger keeps up from changes: first all orders, then half of them again, unchanged."""
    record = codecs.json_object(customer=F.col("customer").cast("string"), cents=F.col("cents"))
    store = _orders_store(spark, d, "live_stats", "ord/", record)
    store.drain("t", batch=STEP)
    again = store.scan_prefix(b"ord/").where(F.substring("key", -1, 1) < F.lit(b"5"))
    store.write_frame(again.select(F.col("seqno").alias("ord"), F.lit(PUT).alias("kind"), "key", "value"))
    store.drain("t", batch=STEP)
    stats = store.scan_prefix(b"stat/").select(F.substr(F.decode("key", "UTF-8"), F.lit(6)).alias("customer"), F.from_json(F.col("value").cast("string"), "orders long, cents long").alias("s"))
    return stats.select("customer", "s.orders", "s.cents")


@_query(ORDERS + "SELECT 'idx/customer/' || customer || '/' || lpad(CAST(id AS VARCHAR), 8, '0') AS key FROM recs")
def store_customer_index(spark, d):
    store = _orders_store(spark, d, "customer_index", "orders/", codecs.json_object(customer=F.col("customer").cast("string")))
    store.drain("t", batch=STEP)
    return store.scan_prefix(b"idx/customer/").select(F.col("key").cast("string").alias("key"))


@_query(ORDERS + "SELECT lpad(CAST(id AS VARCHAR), 8, '0') AS id, 'put' AS op, CAST(customer AS VARCHAR) AS customer, row_number() OVER (ORDER BY id) AS nth FROM recs")
def store_order_feed(spark, d):
    store = _orders_store(spark, d, "order_feed", "orders/", codecs.json_object(customer=F.col("customer").cast("string")))
    first = store.seqno() - table(spark, d, "orders").count()
    store.drain("t", batch=STEP)
    event = F.from_json(F.col("value").cast("string"), "seqno long, op string, id string, record struct<customer: string>").alias("e")
    return store.scan_prefix(b"feed/").select(event).select("e.id", "e.op", "e.record.customer", (F.col("e.seqno") - first).alias("nth"))


@_query("SELECT 'idx/brand/' || p_brand || '/' || p_partkey AS key FROM part")
def store_dynamic_index(spark, d):
    """An index made by its spec, then swapped to another field, with the records there before."""
    store = _empty(spark)
    store.install("dynamic_index", EXAMPLES["dynamic_index"])
    store.create_trigger("spec", b"idxspec/", b"idxspec0", module="dynamic_index")
    rows = table(spark, d, "part")
    value = codecs.json_object(brand=F.col("p_brand"), size=F.col("p_size"))
    store.write_frame(rows.select(F.col("p_partkey").alias("ord"), F.lit(PUT).alias("kind"), F.concat(F.lit("rec/"), F.col("p_partkey")).cast("binary").alias("key"), value.cast("binary").alias("value")))
    for field in (b"size", b"brand"):
        store.put(b"idxspec/brand", b'{"field":"%s"}' % field)
        store.drain("spec")
    return store.scan_prefix(b"idx/brand/").select(F.col("key").cast("string").alias("key"))


@_query("SELECT 'doc/' || r_regionkey AS key FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE') UNION ALL SELECT 'doc/' || n_regionkey || '/' || n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))")
def store_cascade(spark, d):
    store = _empty(spark)
    store.install("cascade_delete", EXAMPLES["cascade_delete"])
    store.create_trigger("c", b"doc/", b"doc0", module="cascade_delete")
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    parents = region.select(F.col("r_regionkey").alias("ord"), F.concat(F.lit("doc/"), F.col("r_regionkey")).alias("key"))
    children = nation.select((F.col("n_nationkey") + 1000).alias("ord"), F.concat_ws("/", F.lit("doc"), F.col("n_regionkey"), F.col("n_nationkey")).alias("key"))
    store.write_frame(parents.union(children).select("ord", F.lit(PUT).alias("kind"), F.col("key").cast("binary").alias("key"), F.lit(b"").alias("value")))
    gone = region.where("r_name IN ('ASIA', 'EUROPE')")
    store.write_frame(gone.select(F.col("r_regionkey").alias("ord"), F.lit(DELETE).alias("kind"), F.concat(F.lit("doc/"), F.col("r_regionkey")).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value")))
    store.drain("c")
    return store.scan_prefix(b"doc/").select(F.col("key").cast("string").alias("key"))


@_query(EVENT_LOG + f"SELECT CAST(count(DISTINCT key) AS BIGINT) AS touched, CAST(count(*) AS BIGINT) AS events, CAST(0 AS BIGINT) AS stacked, CAST(0 AS BIGINT) AS waiting FROM log WHERE {_RANGE}")
def store_trigger_queue(spark, d):
    """What waits for a trigger in either mode; then its effects, which fire no other trigger; then nothing waits."""
    store = _empty(spark)
    store.create_trigger("keys", LO, HI, "keys")
    store.create_trigger("changes", LO, HI, "changes")
    store.create_trigger("effects", b"seen/", b"seen0", "changes")
    store.write_frame(_ops(spark, d))
    waiting = {r.name: r.pending for r in store.triggers().collect()}

    def note(txn, events):
        txn.put(b"seen/n", str(events.count()).encode())

    for name in ("keys", "changes"):
        store.drain(name, note, STEP)
    after = {r.name: r.pending for r in store.triggers().collect()}
    return spark.createDataFrame([(waiting["keys"], waiting["changes"], after["effects"], after["keys"] + after["changes"])], "touched long, events long, stacked long, waiting long")


# ---- branches and retention -------------------------------------------------------------------


@_query(EVENT_LOG + _STATE.format(where="WHERE seqno <= 3333"))
def store_fork_at(spark, d):
    store = _store(spark, d)
    return _shown(store.fork_at(f"at{uuid.uuid4().hex[:12]}", _folder(spark), _seqno(store, 3333)).scan(), "seqno")


@_query(EVENT_LOG + f", s AS ({_STATE.format(where='')}) SELECT 'parent' AS store, count(*) AS keys FROM s UNION ALL SELECT 'fork', count(*) + 2 FROM s UNION ALL SELECT 'fork of the fork', count(*) + 3 FROM s UNION ALL SELECT 'restored', count(*) + 2 FROM s")
def store_forks(spark, d):
    """Branches of branches, found by their ids, and a copy under a new name."""
    parent = _store(spark, d)
    fork = parent.fork(f"f{uuid.uuid4().hex[:12]}", _folder(spark))
    fork.write([(PUT, b"zz/1", b"1"), (PUT, b"zz/2", b"2")])
    deeper = fork.fork("deeper", _folder(spark))
    deeper.put(b"zz/3", b"3")
    copy = Store.restore_to(spark, fork.path, _folder(spark), "copy")
    stores = Instances(fork)
    found = stores.get(deeper.manifest().identity)
    rows = [(name, s.scan().count()) for name, s in (("parent", parent), ("fork", fork), ("fork of the fork", found), ("restored", copy))]
    stores.close()
    return spark.createDataFrame(rows, "store string, keys long")


@_query(EVENT_LOG + "SELECT key, seqno, kind, CASE WHEN kind = 1 THEN value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY key, seqno <= 5000 ORDER BY seqno DESC) AS r FROM log) WHERE seqno > 5000 OR (r = 1 AND kind = 1)")
def store_compaction(spark, d):
    """Segments merged by size, then everything rewritten under a pin at 5000."""
    store = _written(spark, d, 2)
    store.compact_tier()
    store.pin("p", _seqno(store, 5000))
    store.compact()
    return _shown(store.log(), "seqno", "kind")


# ---- streams, journals, replicas ------------------------------------------------------------


@_query(EVENT_LOG + f"SELECT seqno, CASE WHEN kind = 1 THEN 'PUT' ELSE 'DELETE' END AS op, key, CASE WHEN kind = 1 THEN value END AS value FROM log WHERE {_RANGE}")
def store_stream(spark, d):
    """Structured Streaming over a store that is rewritten between two runs: no change is lost or comes twice."""
    store, folder = _empty(spark), _folder(spark)
    ops = _ops(spark, d)
    half = ops.count() // 2

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    store.hold("stream", 0)
    for part in (ops.where(F.col("ord") < half), ops.where(F.col("ord") >= half)):
        store.write_frame(part)
        subscriptions.run_available(store, f"{folder}/checkpoint", keep, LO, HI)
        store.compact_tier()
        store.compact(0)
    return _shown(spark.read.parquet(f"{folder}/out"), "seqno", "op")


@_query(EVENT_LOG + f"SELECT seqno, CASE WHEN kind = 1 THEN 'PUT' ELSE 'DELETE' END AS op, key, CASE WHEN kind = 1 THEN value END AS value FROM log WHERE {_RANGE} AND seqno > 2000")
def store_subscription(spark, d):
    store = _store(spark, d)
    own = subscriptions.Subscription(store, LO, HI, after=_seqno(store, 2000), lag_bytes=0)
    rows = own.poll()
    own.close()
    return _shown(rows, "seqno", "op")


@_query(EVENT_LOG + f"SELECT key, value FROM ({_STATE.format(where='')})")
def store_journal(spark, d):
    """A base after the first half of the events, a delta of the rest, and a store rebuilt from them."""
    store, folder = _empty(spark), _folder(spark)
    ops = _ops(spark, d)
    half = ops.count() // 2
    store.write_frame(ops.where(F.col("ord") < half))
    kept = journal.Journal.attach(store, folder)
    store.write_frame(ops.where(F.col("ord") >= half))
    kept.drain()
    return _shown(journal.rebuild(spark, folder, _folder(spark), "rebuilt").scan())


@_query(EVENT_LOG + f"SELECT key, value FROM ({_STATE.format(where=f'WHERE {_RANGE}')})")
def store_replica(spark, d):
    """A replica of a range: a slice of the first half of the events, then the changes of the rest."""
    store = _empty(spark)
    ops = _ops(spark, d)
    half = ops.count() // 2
    store.write_frame(ops.where(F.col("ord") < half))
    edge = Replica(_folder(spark), LO, HI)
    following = edge.attach(store, lag_bytes=0)
    store.write_frame(ops.where(F.col("ord") >= half))
    edge.follow(following)
    return _shown(edge.scan())


@_query(EVENT_LOG + """, c AS (SELECT *, CASE WHEN seqno <= n // 4 THEN n // 4 WHEN seqno <= n * 2 // 4 THEN n * 2 // 4 WHEN seqno <= n * 3 // 4 THEN n * 3 // 4 ELSE n END AS done FROM (SELECT *, count(*) OVER () AS n FROM log)),
  v AS (SELECT *, lead(seqno) OVER (PARTITION BY key ORDER BY seqno) AS nxt FROM log)
  SELECT c.key, c.seqno, CASE WHEN v.kind = 1 THEN v.value END AS state_value FROM c LEFT JOIN v ON v.key = c.key AND v.seqno <= c.done AND (v.nxt IS NULL OR v.nxt > c.done)""")
def store_state_at_commits(spark, d):
    """For each change what its key held when its commit was done."""
    store = _store(spark, d)
    rows = subscriptions.at_commits(store.log().select("key", "seqno", "commit_seqno"), store.log())
    return rows.select(F.col("key").cast("string").alias("key"), "seqno", F.col("state_value").cast("string").cast("long").alias("state_value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
