"""What a store promises under concurrency, crashes and time: each test names what could go wrong."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.sources.files import Files
from tidelog.sources.store import COMPLETE, DELETE, PUT, Store, Txn, pick_tier
from tidelog.streaming import journal, subscriptions
from tidelog.streaming.replica import Replica
from tidelog.streaming.subscriptions import Subscription


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"file://{tmp_path}/main", "main")


def state(store, prefix=b""):
    return {bytes(r.key): bytes(r.value) for r in store.scan_prefix(prefix).collect()}


def puts(n, prefix=b"k", tag=b"v"):
    return [(PUT, prefix + b"%03d" % k, tag + b"%d" % k) for k in range(n)]


def at_once(*calls):
    """Runs the calls together; their errors."""
    wrong, gate = [], threading.Barrier(len(calls))

    def run(call):
        gate.wait()
        try:
            call()
        except Exception as error:  # noqa: BLE001
            wrong.append(error)

    threads = [threading.Thread(target=run, args=(c,)) for c in calls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return wrong


# ---- the chain of manifests -----------------------------------------------------------------


def test_torn_manifest_was_never_committed(spark, store, tmp_path):
    store.put(b"a", b"1")
    for text in ("", '{"version": 2, "na', "\x00\x00"):
        version = store.manifest().version
        (tmp_path / "main/_commits" / f"{version + 1:020}.json").write_text(text)
        again = Store(spark, store.path)
        assert state(again)[b"a"] and again.manifest().version == version
        store.put(b"b%d" % version, b"2")
        assert Store(spark, store.path).manifest().version == version + 1
    assert len(state(Store(spark, store.path))) == 4


@pytest.mark.parametrize("local", [True, False])
def test_a_name_is_published_once(spark, tmp_path, monkeypatch, local):
    """By a link, and as on other file systems by a rename that doesn't overwrite."""
    files = Files(spark)
    monkeypatch.setattr(Files, "_is_local", staticmethod(lambda fs: local))
    at = f"file://{tmp_path}/folder/name.json"
    assert files.publish(at, "first") and not files.publish(at, "second") and files.read(at) == "first"
    taken, real = [], Files.put_bytes

    def late(self, path, data):
        real(self, path, data)
        if not taken:
            taken.append(real(self, f"file://{tmp_path}/folder/other.json", b"theirs"))

    monkeypatch.setattr(Files, "put_bytes", late)
    assert not files.publish(f"file://{tmp_path}/folder/other.json", "mine") and files.read(f"file://{tmp_path}/folder/other.json") == "theirs"
    assert sorted(files.names(f"file://{tmp_path}/folder")) == ["name.json", "other.json"]


def test_no_manifest_is_ever_seen_in_part(store, tmp_path):
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            for p in (tmp_path / "main/_commits").glob("0*.json"):
                seen.append(json.loads(p.read_text())["version"])

    watcher = threading.Thread(target=look)
    watcher.start()
    for k in range(12):
        store.pin(f"p{k}")
    stop.set()
    watcher.join()
    assert max(seen) >= 10


def test_manifests_say_what_changed_and_cold_opens_agree(spark, store, tmp_path):
    for k in range(COMPLETE + 3):
        store.pin(f"p{k}")
    store.write(puts(3))
    store.compact()
    raws = [json.loads(p.read_text()) for p in sorted((tmp_path / "main/_commits").glob("0*.json"))]
    assert ["segments" in r for r in raws].count(True) == 2
    assert vars(Store(spark, store.path).manifest()) == vars(store.manifest())


def test_many_writers_lose_nothing(spark, store):
    own = [Store(spark, store.path) for _ in range(4)]
    wrong = at_once(*(lambda s=s, k=k: [s.put(b"w%d/%d" % (k, i), b"x") for i in range(4)] for k, s in enumerate(own)))
    assert not wrong and len(state(store)) == 16 and store.seqno() == 16
    assert store.log().select("seqno").distinct().count() == 16


def test_counter_under_conflicts(spark, store):
    store.put(b"n", b"0")

    def add(txn, args):
        txn.put(b"n", str(int(txn.get_for_update(b"n")) + 1).encode())

    own = [Store(spark, store.path) for _ in range(3)]
    assert not at_once(*(lambda s=s: [s.execute(add, retries=20) for _ in range(3)] for s in own))
    assert store.get(b"n") == b"9"


# ---- compaction -----------------------------------------------------------------------------


def test_two_compactions_at_once(spark, store):
    for k in range(3):
        store.write(puts(2, tag=b"%d/" % k))
    assert not at_once(store.compact, Store(spark, store.path).compact)
    assert store.log().count() == 2 and len(state(store)) == 2


def test_a_pin_set_while_compacting_is_honoured(spark, store, monkeypatch):
    store.write(puts(2, tag=b"old"))
    store.write(puts(2, tag=b"new"))
    other, write, pinned = Store(spark, store.path), Store._rewritten, []

    def slow(self, rows, folder):
        if not pinned:
            pinned.append(1)
            other.pin("late", 2)
        return write(self, rows, folder)

    monkeypatch.setattr(Store, "_rewritten", slow)
    store.compact()
    assert state_at(store, 2) == {b"k000": b"old0", b"k001": b"old1"}


def state_at(store, seqno):
    return {bytes(r.key): bytes(r.value) for r in store.scan(at=store.snapshot_at(seqno)).collect()}


def test_writes_while_compacting_stay(spark, store, monkeypatch):
    store.write(puts(3))
    other, write = Store(spark, store.path), Store._rewritten

    def slow(self, rows, folder):
        out = write(self, rows, folder)
        other.put(b"late", b"1")
        return out

    monkeypatch.setattr(Store, "_rewritten", slow)
    store.compact()
    assert len(state(store)) == 4


def test_tiers_merge_small_segments(store):
    for k in range(5):
        store.put(b"k%d" % k, b"v")
    before = store.log().count()
    assert store.compact_tier() and len(store.manifest().segments) < 5 and store.log().count() == before
    assert not store.compact_tier() and store.watermark() == 0
    sized = lambda *rows: [{"rows": r} for r in rows]
    assert pick_tier(sized(1, 2, 3, 1, 100)) == sized(1, 2, 3, 1) and pick_tier(sized(5, 6, 20, 100)) == []


def test_writers_merge_when_there_are_too_many_segments(store, monkeypatch):
    monkeypatch.setattr("tidelog.sources.store.STALL", 6)
    for k in range(14):
        store.put(b"k%02d" % k, b"v")
    assert len(store.manifest().segments) <= 7 and len(state(store)) == 14 and store.seqno() == 14


def test_segments_that_are_gone(store):
    store.write(puts(3))
    path = store.manifest().segments[0]["path"]
    assert store.fetch(path).count() == 3
    store.compact()
    with pytest.raises(errors.Gone):
        store.fetch(path)


def test_vacuum_spares_what_forks_and_readers_name(spark, store, tmp_path):
    store.write(puts(3, tag=b"a"))
    fork = store.fork("f", f"file://{tmp_path}/fork")
    store.write(puts(3, tag=b"b"))
    (tmp_path / "main/segments/lost").mkdir()
    (tmp_path / "main/segments/lost/part-0").write_text("x")
    store.compact()
    assert store.vacuum() == []  # nothing is old enough
    gone = store.vacuum(older_than_ms=0)
    assert "lost" in gone and len(gone) >= 2
    assert set(state(fork).values()) == {b"a0", b"a1", b"a2"} and set(state(store).values()) == {b"b0", b"b1", b"b2"}
    store.delete_fork("f")
    store.vacuum(older_than_ms=0)
    assert len(state(store)) == 3 and not (tmp_path / "fork/_commits").exists()


def test_damage_is_found(spark, store):
    store.write(puts(3))
    store.verify()
    path = store.manifest().segments[0]["path"]
    rows = spark.read.parquet(path).withColumn("value", F.lit(b"changed")).collect()
    spark.createDataFrame(rows, spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    with pytest.raises(errors.Corruption):
        store.verify()


# ---- writes and transactions ----------------------------------------------------------------


def test_frames_of_operations_are_one_commit(spark, store):
    ops = spark.range(500).select(F.col("id").alias("ord"), F.when(F.col("id") % 5 == 4, DELETE).otherwise(PUT).alias("kind"), F.concat(F.lit("k"), (F.col("id") % 100).cast("string")).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    assert store.write_frame(ops) == 500
    log = store.log().collect()
    assert sorted(r.seqno for r in log) == list(range(1, 501)) and {r.commit_seqno for r in log} == {500}
    model = {}
    for k in range(500):
        model.pop(b"k%d" % (k % 100), None) if k % 5 == 4 else model.update({b"k%d" % (k % 100): b"%d" % k})
    assert state(store) == model
    assert store.write_frame(ops.limit(0)) == 500
    for bad in (ops.withColumn("key", F.lit(b"")), ops.withColumn("key", F.lit(b"\x00a")), ops.withColumn("value", F.lit(None).cast("binary")), ops.withColumn("ord", F.lit(1)), ops.withColumn("kind", F.lit(7))):
        with pytest.raises(errors.InvalidArgument):
            store.write_frame(bad)
    assert store.seqno() == 500


def test_transactions_at_their_edges(store):
    store.write(puts(2))
    txn = store.begin()
    assert txn.commit() == 2  # neither writes nor locks
    txn.get_for_update(b"k000")
    assert txn.commit() == 2 and store.seqno() == 2
    locked, gone = store.begin(), store.begin()
    locked.get_for_update(b"k001")
    gone.put(b"k001", b"mine")
    store.delete(b"k001")
    for t in (locked, gone):
        with pytest.raises(errors.Conflict):
            t.commit()
    gone.rollback()
    assert gone.commit() == 3 and gone.get(b"k001") == b"v1"
    big = store.begin()
    for k in range(300):
        big.put(b"m%03d" % k, b"")
    store.put(b"m123", b"x")
    with pytest.raises(errors.Conflict):
        big.commit()
    with pytest.raises(errors.InvalidArgument):
        store.write([(PUT, b"ok", b"1"), (PUT, b"", b"2")])
    assert store.get(b"ok") is None


def test_scan_of_a_transaction_is_frozen(store):
    store.write(puts(2))
    txn = store.begin()
    txn.put(b"a", b"1")
    rows = txn.scan()
    txn.put(b"b", b"2")
    assert [bytes(r.key) for r in rows.collect()] == [b"a", b"k000", b"k001"]


# ---- triggers -------------------------------------------------------------------------------


def test_an_event_written_while_draining_comes_once(spark, store):
    store.create_trigger("t", b"u/", b"v/", "changes")
    store.write(puts(1, b"u/"))
    other, seen = Store(spark, store.path), []

    def note(txn, events):
        if not seen:
            other.put(b"u/late", b"x")
        seen.extend(bytes(r.key) for r in events.collect())
        txn.put(b"seen", b",".join(seen))

    store.drain("t", note)
    store.drain("t", note)
    assert seen == [b"u/000", b"u/late"]


def test_a_step_that_conflicts_runs_again(spark, store):
    store.create_trigger("t", b"u/", b"v/")
    store.write([(PUT, b"n", b"0"), *puts(3, b"u/")])
    other, runs = Store(spark, store.path), []

    def count(txn, keys):
        old = int(txn.get_for_update(b"n"))
        if not runs:
            other.put(b"n", b"10")
        runs.append(old)
        txn.put(b"n", b"%d" % (old + keys.count()))

    store.drain("t", count)
    assert runs == [0, 10] and store.get(b"n") == b"13" and store.pending("t").count() == 0


def test_backlog_drains_in_steps_across_openings(spark, store):
    store.create_trigger("t", b"u/", b"v/", "changes")
    for k in range(3):
        store.write(puts(7, b"u/", b"%d/" % k))
    sizes = []

    def note(txn, events):
        n = events.count()
        sizes.append(n)
        txn.put(b"sum", b"%d" % (int(txn.get(b"sum") or 0) + n))
        if len(sizes) == 3:
            raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        store.drain("t", note, batch=4)
    assert Store(spark, store.path).drain("t", note, batch=4) == 4
    assert store.get(b"sum") == b"21" and sizes == [4, 4, 4, 4, 4, 4, 1]
    store.put(b"u/x", b"v" * 100)
    with pytest.raises(errors.InvalidArgument):
        store.drain("t", note, most_bytes=50)
    store.drain("t", note, most_bytes=200)
    assert store.get(b"sum") == b"22"


def test_rules_of_triggers(store):
    for name, lo, hi in (("a b", b"a", b"b"), ("t", b"b", b"a"), ("t", b"\x00a", b"b"), ("t", b"", b"b")):
        with pytest.raises(errors.InvalidArgument):
            store.create_trigger(name, lo, hi)
    store.create_trigger("t", b"a", b"b")
    for call in (lambda: store.create_trigger("t", b"a", b"b"), lambda: store.delete_trigger("x"), lambda: store.create_trigger("m", b"a", b"b", module="none"), lambda: store.create_trigger("m", b"a", b"b", "other")):
        with pytest.raises(errors.InvalidArgument):
            call()
    store.put(b"a1", b"")
    store.set_triggers(False)
    for call in (lambda: store.drain("t"), lambda: store.create_trigger("u", b"a", b"b")):
        with pytest.raises(errors.InvalidArgument):
            call()
    assert [r.name for r in store.triggers().collect()] == ["t"]
    store.set_triggers(True)  # what came meanwhile is skipped
    assert store.pending("t").count() == 0
    store.put(b"a2", b"")
    assert store.triggers().first().pending == 1
    store.delete_trigger("t")
    assert store.triggers().count() == 0


def test_failures_wait_longer_each_time(store):
    store.create_trigger("t", b"a", b"b")
    store.put(b"a1", b"")

    def broken(txn, events):
        raise ValueError("é" * 600)

    waits = []
    for _ in range(3):
        with pytest.raises(ValueError):
            store.drain("t", broken)
        t = store.manifest().triggers["t"]
        waits.append(t["retry_at_ms"] - time.time() * 1000)
        assert len(t["last_error"].encode()) <= 500
    assert waits == sorted(waits) and store.pending("t").count() == 1


# ---- streams --------------------------------------------------------------------------------


def test_feed_matches_commit_order_through_rewrites(spark, store, tmp_path):
    store.hold("all", 0)
    got = []
    for k in range(3):
        store.write([(PUT, b"k1", b"%d" % k), (DELETE, b"k2", None), (PUT, b"z", b"")])
        subscriptions.run_available(store, f"{tmp_path}/check", lambda batch, _: got.extend((r.seqno, r.op) for r in batch.collect()), b"k", b"l")
        store.compact()
    assert got == [(1, "PUT"), (2, "DELETE"), (4, "PUT"), (5, "DELETE"), (7, "PUT"), (8, "DELETE")]


def test_subscription_holds_lags_and_ends(store):
    store.put(b"k0", b"")
    items = subscriptions.changes(store, b"k", b"l", polls=2)
    assert next(items) == {"op": "ATTACHED", "seqno": 1, "commit_seqno": 1, "key": None, "value": None}
    store.write([(PUT, b"k1", b"1"), (PUT, b"x", b""), (DELETE, b"k0", None)])
    store.compact()
    assert [(i["op"], i["seqno"], i["commit_seqno"], i["value"]) for i in items] == [("PUT", 2, 4, b"1"), ("DELETE", 4, 4, None)]
    assert store.manifest().holds == {}
    slow = Subscription(store, lag_bytes=100)
    store.put(b"big", b"x" * 200)
    with pytest.raises(errors.Lagged):
        slow.poll()
    with pytest.raises(errors.Closed):
        slow.poll()
    with pytest.raises(errors.InvalidArgument):
        Subscription(store, b"b", b"a")
    store.compact()
    with pytest.raises(errors.Gone):
        Subscription(store, after=1)
    with pytest.raises(errors.InvalidArgument):
        Subscription(store, after=10**6)


def test_query_of_each_event_sees_its_whole_commit(store):
    store.write([(PUT, b"a", b"1"), (PUT, b"b", b"1")])
    store.write([(PUT, b"a", b"2"), (PUT, b"b", b"2")])
    rows = subscriptions.subscribe(store.log(), None, None)
    got = list(subscriptions.query_each(store, rows, lambda s, at: (s.get(b"a", at), s.get(b"b", at))))
    assert got == [(1, (b"1", b"1")), (2, (b"1", b"1")), (3, (b"2", b"2")), (4, (b"2", b"2"))]


# ---- journals and replicas ------------------------------------------------------------------


def test_journal_follows_heals_and_compacts(spark, store, tmp_path):
    at = f"file://{tmp_path}/journal"
    store.write(puts(5))
    own = journal.Journal.attach(store, at, compact_least=1 << 40)
    for k in range(3):
        store.write([(PUT, b"k000", b"%d" % k), (DELETE, b"k00%d" % (k + 1), None)])
        assert own.drain() == store.seqno()
        store.compact()
    assert journal.equal_state(store, at) and own.drain() == store.seqno()
    found = journal.headers(own.files, own.path)
    assert [h["kind"] for h in found] == ["base", "delta", "delta", "delta"]
    built = journal.rebuild(spark, at, f"file://{tmp_path}/built", "built")
    assert state(built) == state(store) and built.manifest().identity != store.manifest().identity
    # its place was given up and compacted away: a new base heals it
    own.detach()
    store.write([(DELETE, b"k000", None), (PUT, b"new", b"")])
    store.compact()
    own.drain()
    assert journal.headers(own.files, own.path)[-1]["kind"] == "base" and journal.equal_state(store, at)
    own.compact_least, own.compact_when = 1, 0.0
    store.put(b"more", b"")
    own.drain()
    assert [h["kind"] for h in journal.headers(own.files, own.path)] == ["base"] and journal.equal_state(store, at)
    again = journal.Journal.attach(store, at)
    assert again.drain() == store.seqno()
    other = Store.create(spark, f"file://{tmp_path}/other", "other")
    with pytest.raises(errors.ProvenanceMismatch):
        journal.Journal.attach(other, at)


def test_journal_integrity(spark, store, tmp_path):
    at, headers = f"file://{tmp_path}/journal", tmp_path / "journal/_headers"
    own = journal.Journal.attach(store, at)
    for k in range(3):
        store.put(b"k%d" % k, b"v")
        own.drain()
    names = sorted(p.name for p in headers.glob("0*.json"))
    texts = {n: (headers / n).read_text() for n in names}

    def broken(error, change):
        change()
        with pytest.raises(error):
            journal.state(spark, at)
        for n, t in texts.items():
            (headers / n).write_text(t)

    broken(errors.JournalGap, lambda: (headers / names[2]).unlink())
    broken(errors.Corruption, lambda: (headers / names[1]).write_text("{"))
    raw = json.loads(texts[names[2]])
    broken(errors.Corruption, lambda: (headers / names[2]).write_text(json.dumps(raw | {"last": 0})))
    broken(errors.ProvenanceMismatch, lambda: (headers / names[3]).write_text(json.dumps(json.loads(texts[names[3]]) | {"identity": "x"})))
    (headers / names[3]).write_text(texts[names[3]][:10])  # a torn last part isn't there yet
    rows, seqno = journal.state(spark, at)
    assert rows.count() == 2 and seqno == 2


def test_replica_of_a_range(spark, store, tmp_path):
    store.write(puts(30))
    edge = Replica(f"file://{tmp_path}/edge", b"k010", b"k020")
    following = edge.attach(store)
    store.write([(PUT, b"k011", b"new"), (DELETE, b"k012", None), (PUT, b"k025", b"out"), (PUT, b"k0155", b"more")])
    following = edge.follow(following)
    want = {k: v for k, v in state(store).items() if b"k010" <= k < b"k020"}
    read = lambda rows: {bytes(r.key): bytes(r.value) for r in rows.collect()}
    assert read(edge.scan()) == want and edge.get(b"k011") == b"new" and edge.get(b"k012") is None
    assert edge.scan(b"k000", b"k005").count() == 0 and set(read(edge.scan(b"k000", b"k012"))) == {b"k010", b"k011"}
    with pytest.raises(errors.InvalidArgument):
        edge.get(b"k025")
    # too far behind: a new slice
    following.lag_bytes = 10
    store.write(puts(30, tag=b"again"))
    following = edge.follow(following)
    assert edge.stats()["resyncs"] == 1 and edge.stats()["position"] == store.seqno()
    assert read(edge.scan()) == {k: v for k, v in state(store).items() if b"k010" <= k < b"k020"}
    # another master: nothing of the first is kept
    other = Store.create(spark, f"file://{tmp_path}/other", "other")
    other.put(b"k013", b"theirs")
    edge.attach(other)
    assert read(edge.scan()) == {b"k013": b"theirs"}
    with pytest.raises(errors.ProvenanceMismatch):
        Replica(f"file://{tmp_path}/e2").attach(Store.create(spark, f"file://{tmp_path}/noname"))


# ---- names and branches ---------------------------------------------------------------------


def test_names_adopted_and_verified(spark, store, tmp_path):
    bare = Store.create(spark, f"file://{tmp_path}/bare")
    assert bare.manifest().identity == ""
    named = Store(spark, bare.path, "given")
    assert named.manifest().name == "given" and Store(spark, bare.path, "given").manifest().identity == named.manifest().identity
    with pytest.raises(errors.ProvenanceMismatch):
        Store(spark, bare.path, "other")
    with pytest.raises(errors.InvalidArgument):
        Store.create(spark, f"file://{tmp_path}/x", "a/b")
    with pytest.raises(errors.InvalidArgument):
        Store(spark, f"file://{tmp_path}/nothing")


def test_forks_are_listed_deleted_and_restored(spark, store, tmp_path):
    store.write(puts(2))
    store.pin("p")
    fork = store.fork("f", f"file://{tmp_path}/f")
    assert fork.pins().count() == 0 and fork.manifest().parent == store.manifest().identity != fork.manifest().identity
    assert [r.name for r in store.forks().collect()] == ["f"] and store.pins().first().seqno == 2
    mark = fork.open()
    for call in (lambda: store.delete_fork("f"), lambda: store.delete_fork("x"), lambda: store.fork("f", f"file://{tmp_path}/g"), lambda: Store.restore_to(spark, fork.path, f"file://{tmp_path}/r", "r"), lambda: store.pin("p"), lambda: store.unpin("q")):
        with pytest.raises(errors.InvalidArgument):
            call()
    fork.close(mark)
    for name in (None, "f"):
        with pytest.raises(errors.InvalidArgument):
            Store.restore_to(spark, fork.path, f"file://{tmp_path}/r", name)
    fork.put(b"own", b"1")
    back = Store.restore_to(spark, fork.path, f"file://{tmp_path}/r", "r")
    store.delete_fork("f")
    assert len(state(back)) == 3 and store.forks().count() == 0 and back.seqno() == 3
    back.put(b"more", b"")
    assert back.seqno() == 4


def test_scans_of_a_view(store):
    store.write(puts(3))
    view = store.begin()
    assert list(view.entries(b"k001")) == [(b"k001", b"v1"), (b"k002", b"v2")]
    keys = store.query(lambda v, args: v.keys())
    assert [bytes(r.key) for r in keys.collect()] == [b"k000", b"k001", b"k002"]
    with pytest.raises(errors.ModuleError):
        store.query(lambda v, args: [v.scan() for _ in range(65)])


def test_key_filters_are_stored(spark, store, tmp_path):
    """Segments carry a Bloom filter of their keys, beside the ranges."""
    store.write(puts(3))
    files = list((tmp_path / "main/segments").glob("*/part-*.parquet"))
    reader = spark.sparkContext._jvm.org.apache.parquet.hadoop.ParquetFileReader
    source = spark.sparkContext._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(files[0])), spark.sparkContext._jsc.hadoopConfiguration())
    opened = reader.open(source)
    block = opened.getFooter().getBlocks().get(0)
    filters = {c.getPath().toDotString(): opened.readBloomFilter(c) is not None for c in block.getColumns()}
    opened.close()
    assert filters["key"] and not filters["value"]


def test_read_only_view_and_snapshots(store):
    store.put(b"a", b"1")
    with pytest.raises(errors.InvalidArgument):
        store.query(lambda view, args: view.put(b"a", b"2"))
    assert store.query(lambda view, args: view.get(b"a")) == b"1" and isinstance(store.begin(), Txn)
    with pytest.raises(errors.InvalidArgument):
        store.snapshot_at(99)
