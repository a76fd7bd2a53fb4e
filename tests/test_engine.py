import duckdb
import pytest

from tidelog.functions import codecs
from tidelog.operators import mvcc, txn
from tidelog.plans import queries, store_queries

SF = "/root/testdata/sf0.001"


def values(rows):
    return sorted((tuple(None if v != v else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


BOTH = {**queries.QUERIES, **store_queries.QUERIES}
ALL_SQL = {**queries.SQL, **store_queries.SQL}


@pytest.mark.parametrize("name", sorted(BOTH))
def test_query_matches_sql(spark, duck, name):
    if name not in ALL_SQL:
        pytest.skip("no SQL: a test of its own")
    got = BOTH[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({ALL_SQL[name]})").fetchall()
    assert values(map(tuple, got.select(*columns).collect())) == values(want)


def test_range_filters_reach_the_files(spark):
    store = store_queries._store(spark, SF)
    rows = store.scan(b"usr/00000002", b"usr/00000009", store.snapshot_at(400))
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = rows._jdf.queryExecution().explainString(mode)
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line)
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed and "LessThanOrEqual(seqno" in pushed


def test_prefix_end():
    assert codecs.prefix_end(b"a\xff") == b"b"
    assert codecs.prefix_end(b"\xff\xff") is None
    assert codecs.prefix_end(b"") is None


def test_uvarint_round_trip():
    for n in (0, 127, 128, 2**64 - 1):
        assert codecs.read_uvarint(codecs.uvarint(n)) == (n, len(codecs.uvarint(n)))
    assert codecs.read_uvarint(b"\x80") is None


def test_transfer_to_oneself_adds(spark):
    moves = spark.createDataFrame([(1, "a", "a", 5), (2, "a", "b", 100), (3, "b", "x", 1)], "ord int, src string, dst string, amount long")
    assert {r.account: r.balance for r in txn.transfer_fold(moves, ["a", "b"], 10).collect()} == {"a": 15, "b": 10}


def test_transfers_of_all_events(spark):
    balance = [1000] * 4
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").orderBy("event_id").collect()
    assert len(events) > 500
    for e in events:
        src, dst, amount = e.user_id % 4, e.user_id // 4 % 4, e.event_id % 700
        if balance[src] >= amount:
            left, got = balance[src] - amount, balance[dst] + amount
            balance[src] = left
            balance[dst] = got
    assert {r.account: r.balance for r in queries.transfer_fold(spark, SF).collect()} == {f"acct/{k}": b for k, b in enumerate(balance)}


def test_slices_hold_all_rows(spark):
    segments = {}
    for e in spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "user_id").collect():
        segments.setdefault(e.event_id // 1000, []).append(f"usr/{e.user_id:08}")
    want = {k: len(v) for k, v in segments.items() if max(v) >= "usr/00000020" and min(v) < "usr/00000025"}
    assert want and {r.segment: r.n for r in queries.slice_overlap(spark, "/root/testdata/sf0.01").collect()} == want


def test_aborted_attempts_do_not_count(spark):
    tries = spark.createDataFrame([("k", 10, 0), ("k", 20, 5), ("k", 30, 12)], "key string, seqno long, snap long")
    assert [r.committed for r in txn.first_committer_wins(tries).orderBy("seqno").collect()] == [True, False, True]


def test_page_limits(spark):
    with pytest.raises(Exception, match="limit"):
        mvcc.page(spark.createDataFrame([], "key string, seqno long, commit_seqno long, kind int, value long"), 0)


def test_stream_of_changes(spark, tmp_path):
    from tidelog.streaming import subscriptions

    schema = "key string, seqno long, commit_seqno long, kind int, value long"
    log = spark.createDataFrame([("a", 1, 2, 1, 5), ("b", 2, 2, 0, None), ("z", 3, 3, 1, 7)], schema)
    log.write.parquet(f"{tmp_path}/log")
    seen = []
    changes = subscriptions.subscribe(subscriptions.log_stream(spark, f"{tmp_path}/log", schema), "a", "c")
    subscriptions.run_once(changes, f"{tmp_path}/check", lambda batch, _: seen.extend(map(tuple, batch.orderBy("seqno").collect())))
    assert seen == [(1, 2, "PUT", "a", 5), (2, 2, "DELETE", "b", None)]
