import json
import struct

import pytest
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.api import config, frames
from tidelog.api.facade import Api, Instances, answered
from tidelog.api.shell import Shell
from tidelog.functions import codecs
from tidelog.functions.codecs import Change
from tidelog.operators import txn, views
from tidelog.sources.examples import EXAMPLES
from tidelog.sources.store import PUT, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"file://{tmp_path}/main", "main")


def test_pages_and_bytes(store):
    api = Api(store)
    assert api.writeBatch([{"put": {"key": {"text": f"scan/{k}"}, "value": {"hex": f"0{k}ff"}}} for k in range(5)] + [{"put": {"key": "other/x", "value": "ov"}}, {"delete": {"key": {"base64": "bm9uZQ=="}}}]) == 7
    first = api.scan(prefix="scan/", limit=2)
    assert [e["key"]["text"] for e in first["entries"]] == ["scan/0", "scan/1"] and first["hasMore"] and first["nextAfter"]["text"] == "scan/1"
    assert first["entries"][1]["value"] == {"text": None, "base64": "Af8=", "hex": "01ff", "len": 2}
    keys = lambda **a: [e["key"]["text"] for e in api.scan(**a)["entries"]]
    assert keys(prefix="scan/", after="scan/3") == ["scan/4"] and keys(prefix="scan/", after="scan/2", reverse=True) == ["scan/1", "scan/0"]
    assert keys(lo="scan/3", after="scan/1") == ["scan/3", "scan/4"] and keys(hi="scan/1", reverse=True) == ["scan/0", "other/x"] and keys(lo="z", hi="a") == []
    assert api.count("scan/", "scan0") == 5 and api.get("none") is None and api.get({"text": "other/x"})["text"] == "ov"
    codes = [answered(c)["error"]["code"] for c in (lambda: api.scan(limit=0), lambda: api.scan(limit=10_001), lambda: api.scan(prefix="a", lo="b"), lambda: api.get({"text": "a", "hex": "00"}), lambda: api.get({"hex": "abc"}), lambda: api.get({"base64": "*"}), lambda: api.put("k", None), lambda: api.writeBatch([{}]), lambda: api.get("x", at=99))]
    assert codes == ["INVALID_ARGUMENT"] * 9 and answered(lambda: api.seqno()) == {"data": 7}


def test_carry_of_prefixes(store):
    keys = [bytes.fromhex(h) for h in ("fe", "ff", "ff00", "ffff", "abff01", "ac00")]
    store.write([(PUT, k, b"v") for k in keys])
    found = lambda p: [k.hex() for k, _ in Api(store).page(prefix=bytes.fromhex(p))[0]]
    assert found("ff") == ["ff", "ff00", "ffff"] and found("abff") == ["abff01"] and found("ffff") == ["ffff"] and len(found("")) == 6


def test_modules_triggers_and_schema(store):
    api = Api(store)
    api.installModule("placeOrder", EXAMPLES["placeOrder"])
    api.installModule("order_feed", EXAMPLES["order_feed"])
    api.createTrigger("feed", "order_feed", "orders/", "orders0")
    assert api.field("placeOrder", customer="acme", amountCents=5)["id"] == "1"
    assert answered(lambda: api.field("placeOrder", amountCents=5))["error"]["code"] == "INVALID_ARGUMENT"
    failed = answered(lambda: api.wasmExecute("placeOrder", {"customer": "A", "amountCents": 1}))["error"]
    assert failed["code"] == "GUEST_FAILED" and failed["exitCode"] == 3
    assert api.triggers()[0]["pending"] == 2  # the order and the counter are both in range
    store.drain_all()
    events = list(api.feed("order_feed"))
    assert events[0]["event"]["record"]["customer"] == "acme" and events[0]["error"] is None
    store.put(b"feed/bad", b"{}")
    assert list(api.feed("order_feed", after=store.seqno() - 1))[0]["event"] is None
    assert [m["name"] for m in api.modules()] == ["order_feed", "placeOrder"] and all(m["typed"] for m in api.modules())
    # a declaration that isn't sound leaves the module without a field
    broken = EXAMPLES["agg"].__class__(query=EXAMPLES["agg"].query)
    store.install("odd", broken)
    entry = store.manifest().modules["odd"][-1]
    broken.describe = {"kind": "query"}
    store.files.put_bytes(entry["path"], broken.dumps())
    entry["hash"] = codecs.content_hash(broken.dumps())
    store._edit(lambda m: {"modules": {**m.modules, "odd": [entry]}})
    assert api.reloadSchema() == ["order_feed", "placeOrder"] and "odd" in api.schema_errors
    assert api.uninstallModule("odd") and api.deleteTrigger("feed") and api.syncWal() and api.flush() and api.compactAll() and api.gcVlog() == 0
    deep = []
    for _ in range(40):
        deep = [deep]
    assert answered(lambda: api.wasm("placeOrder", deep))["error"]["code"] == "INVALID_ARGUMENT"


def test_changes_with_a_query_at_each_commit(store):
    api = Api(store)
    items = api.changes("k", "l", query=lambda then: then.get("n"))
    assert next(items)["op"] == "ATTACHED"
    store.write([(PUT, b"k1", b"a"), (PUT, b"n", b"1")])
    store.write([(PUT, b"k2", b"b"), (PUT, b"n", b"2")])
    assert [(i["key"]["text"], i["query"]["text"]) for i in items] == [("k1", "1"), ("k2", "2")]


def test_instances_open_few_and_find_forks_of_forks(spark, store, tmp_path):
    a = store.fork("a", f"file://{tmp_path}/a")
    b = a.fork("b", f"file://{tmp_path}/b")
    c = store.fork("c", f"file://{tmp_path}/c")
    ids = [s.manifest().identity for s in (a, b, c)]
    instances = Instances(store, most=2)
    assert instances.get() is store and [instances.get(i).path for i in ids] == [s.path for s in (a, b, c)]
    assert not a.in_use() and b.in_use() and c.in_use()
    with pytest.raises(errors.InvalidArgument):
        store.delete_fork("c")
    instances.idle = -1
    instances.expire()
    assert not b.in_use() and not c.in_use()
    with pytest.raises(errors.InvalidArgument):
        instances.get("none")


def test_frames(store):
    server = frames.Server(Api(store))

    def ask(op, payload=b""):
        ((request, code, body),) = frames.frames(frames.frame(9, op if isinstance(op, int) else frames.OPS[op], payload))
        ((again, status, out),) = frames.frames(server.answer(request, code, body))
        assert again == 9
        return next(k for k, v in frames.STATUS.items() if v == status), out

    assert ask("HELLO")[1][4:] == b"tidelog" and ask("GET", b"k") == ("NOT_FOUND", b"") and ask("GET", b"")[0] == "INVALID"
    assert ask("PUT", frames.blob(b"k") + b"v") == ("OK", b"") and ask("GET", b"k") == ("OK", b"v")
    batch = struct.pack("<I", 2) + b"\x00" + frames.blob(b"a") + frames.blob(b"1") + b"\x01" + frames.blob(b"k")
    assert ask("BATCH", batch) == ("OK", struct.pack("<I", 2)) and ask("BATCH", batch + b"x")[0] == "BAD_FRAME" and ask("BATCH", batch[:-1])[0] == "BAD_FRAME"
    scan = lambda limit, after=None: ask("SCAN", b"\x00" + frames.maybe(None) * 2 + frames.maybe(after) + struct.pack("<I", limit))
    store.put(b"b", b"2")
    assert scan(1) == ("OK", struct.pack("<I", 1) + frames.blob(b"a") + frames.blob(b"1") + b"\x01" + frames.maybe(b"a"))
    assert scan(5, b"a") == ("OK", struct.pack("<I", 1) + frames.blob(b"b") + frames.blob(b"2") + b"\x00\x00") and scan(0)[0] == "BAD_FRAME"
    store.install("claim", EXAMPLES["claim"])
    claim = frames.blob(b"claim") + json.dumps({"username": "u", "owner": "o"}).encode()
    assert json.loads(ask("EXEC", claim)[1])["already"] is False and ask("EXEC", frames.blob(b"claim") + b"{")[0] == "INVALID"
    status, out = ask("EXEC", frames.blob(b"claim") + json.dumps({"username": "u", "owner": "p"}).encode())
    assert status == "GUEST_FAILED" and struct.unpack_from("<i", out) == (1,)
    assert ask("QUERY", claim)[0] == "INVALID" and ask("SYNC_WAL")[0] == ask("STATS")[0] == "OK" and ask("DEL", b"a")[0] == "OK" and ask(0x77)[0] == "BAD_FRAME"
    with pytest.raises(frames.BadFrame):
        list(frames.frames(struct.pack("<I", 1 << 30)))
    assert list(frames.frames(frames.frame(1, 2)[:-1])) == []
    assert set(frames.OF_CODE.values()) <= set(frames.STATUS)


def test_replication_frames(spark, store, tmp_path):
    store.write([(PUT, b"a%d" % k, b"v%d" % k) for k in range(5)])
    server = frames.Replication(store, lag_bytes=200)

    def ask(op, payload=b""):
        ((_, code, body),) = frames.frames(frames.frame(1, frames.REPLICATION_OPS[op], payload))
        ((_, status, out),) = frames.frames(server.answer(1, code, body))
        return next(k for k, v in frames.REPLICATION_STATUS.items() if v == status), out

    def push():
        ((request, code, out),) = frames.frames(server.push())
        assert request == 0
        return next(k for k, v in frames.REPLICATION_OPS.items() if v == code), out

    status, out = ask("HELLO")
    assert status == "OK" and out[8:].decode() == store.manifest().identity
    status, out = ask("SNAPSHOT", frames.maybe(b"a1") + frames.maybe(b"a4"))
    read = frames.Reader(out)
    head, (path,) = read.number(8), [read.name() for _ in range(read.number(4))]
    status, out = ask("FETCH_TABLE", frames.blob(path.encode()))
    assert head == 5 and [(r[0], r[3], r[4]) for r in frames.unpacked(out)] == [(k + 1, b"a%d" % k, b"v%d" % k) for k in range(5)]
    assert ask("SUBSCRIBE", frames.maybe(b"a") + frames.maybe(b"b") + struct.pack("<Q", head))[0] == "OK" and push()[0] == "PING"
    store.write([(PUT, b"a1", b"new"), (0, b"a2", None), (PUT, b"zz", b"")])
    kind, out = push()
    assert kind == "STREAM" and struct.unpack_from("<Q", out) == (8,) and frames.unpacked(out[8:]) == [(6, 8, 1, b"a1", b"new"), (7, 8, 0, b"a2", None)]
    store.put(b"a9", b"x" * 500)
    assert push()[0] == "LAGGED"
    store.compact()
    assert ask("FETCH_TABLE", frames.blob(path.encode()))[0] == "GONE" and ask("SUBSCRIBE", frames.maybe(None) * 2 + struct.pack("<Q", 1))[0] == "GONE" and ask("SNAPSHOT", b"\x07")[0] == "BAD_FRAME"
    bare = frames.Replication(Store.create(spark, f"file://{tmp_path}/bare"))
    ((_, status, _),) = frames.frames(bare.answer(1, 0, b""))
    assert status == frames.REPLICATION_STATUS["NO_IDENTITY"]


def test_runs_that_take_too_long_are_cancelled(store):
    from tidelog.sources.modules import Module

    def endless(view, args):
        return view.store.spark.range(10**12).selectExpr("sum(hash(id))").first()[0]

    store.install("slow", Module(query=endless))
    with pytest.raises(errors.ModuleError, match="longer"):
        store.query("slow", seconds=2)
    assert store.triggers().where("pending > 0").count() == 0 and store.backlog() == []


def test_configuration():
    made = config.parse('dir = "/data"\nstore_name = "s"\n[engine]\ntrigger_batch = 7\n[journal]\ncompact_when_deltas_exceed = 3\n')
    assert made.dir == "/data" and made.engine.trigger_batch == 7 and made.journal.compact_when_deltas_exceed == 3.0 and made.graphql.fork_max_open == 8
    for text in ("nope = 1", "[engine]\nnope = 1", 'dir = 5', "engine = 3", "dir =", 'sync = "maybe"', "[engine]\nwasm_enabled = 1"):
        with pytest.raises(errors.InvalidArgument):
            config.parse(text)


def test_shell(store):
    said = []
    shell = Shell(store, said.append)
    for line in ("put a 1", "put hex:ff00 x", "get a", "get none", "scan", "scan - b --rev --limit 1", "count", "del a", "seqno", "pin p", "pins", "stats", "nonsense", "get", "query none", ""):
        assert shell.run(line)
    assert not shell.run("quit")
    text = "\n".join(said)
    for part in ('"1"', "(none)", '"a" = "1"', "hex:ff00", "2 entries", "error INVALID_ARGUMENT", "no command nonsense", " ms)"):
        assert part in text, part


# ---- codecs ---------------------------------------------------------------------------------


def test_shown_keys_agree(spark):
    values = ["plain", "", "tab\tand\nline", "é", "x" * 200, "é" * 100, "end\n"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", codecs.display_key(F.col("v")).alias("s")).orderBy("k").collect()
    assert [r.s for r in rows] == [codecs.shown(v.encode()) for v in values]
    assert rows[0].s == '"plain"' and rows[1].s == "hex:" and rows[4].s.endswith("… (200 bytes)") and codecs.shown(b"\xff") == "hex:ff"
    assert codecs.latency(0.0000287) == "(28.7 µs)" and codecs.latency(0.00302) == "(3.02 ms)"


def test_text_prefixes(spark):
    assert codecs.text_prefix_end("¿") == "À" and codecs.text_prefix_end("a\U0010ffff") == "b" and codecs.text_prefix_end("") is None and codecs.text_prefix_end("퟿") == ""
    from tidelog.operators import mvcc

    log = spark.createDataFrame([("¿a", 1, 1, 1, 5), ("À", 2, 2, 1, 6)], "key string, seqno long, commit_seqno long, kind int, value long")
    assert [r.key for r in mvcc.scan_prefix(log, "¿").collect()] == ["¿a"]


def test_packed_trigger_inputs():
    keys = [b"a", b"", b"k" * 300]
    assert codecs.parse_trigger_keys(codecs.pack_keys(keys)) == keys and codecs.parse_trigger_keys(b"\x05ab") is None and codecs.parse_trigger_keys(b"\x80") is None
    changes = [Change(1, b"a", True, b"v"), Change(2, b"b", False), Change(3, b"c", True, None), Change(4, b"d", True, b"")]
    packed = codecs.pack_changes(changes)
    assert codecs.parse_changes(packed) == changes
    for bad in (packed[:-1], packed + b"x", b"", packed[:12] + b"\x07" + packed[13:]):
        assert codecs.parse_changes(bad) is None


def test_columns_of_codecs(spark):
    import base64
    import binascii
    import zlib

    rows = [(k, v, base64.b64encode(v).decode(), v.hex()) for k, v in enumerate([b"", b"a", b"\xff\x00", b"hello world"])]
    df = spark.createDataFrame(rows, "k int, v binary, b string, h string")
    for r in df.select("k", "v", codecs.crc32(F.col("v"), F.lit("x")).alias("c"), codecs.parse_base64(F.col("b")).alias("b"), codecs.parse_hex(F.col("h")).alias("h")).collect():
        assert r.c == zlib.crc32(bytes(r.v) + b"x") and bytes(r.b) == bytes(r.h) == bytes(r.v)
    bad = spark.createDataFrame([("abc", "a"), ("ab==c", "zz")], "b string, h string").select(codecs.parse_base64(F.col("b")).alias("b"), codecs.parse_hex(F.col("h")).alias("h")).collect()
    assert all(r.b is None and r.h is None for r in bad)
    numbers = spark.createDataFrame([(bytearray(codecs.uvarint(5) + codecs.uvarint(2**64 - 1)),), (bytearray(b"\x80"),), (None,)], "v binary")
    assert [r.n for r in numbers.select(codecs.uvarints(F.col("v")).alias("n")).collect()] == [["5", str(2**64 - 1)], None, None]
    keys = spark.createDataFrame([("orders/00000012",), ("orders/next",), ("x",), ("orders/00000012/y",)], "k string")
    assert [r.s for r in keys.select(codecs.key_segment(F.col("k"), "orders/", r"\d{8}").alias("s")).collect()] == ["00000012", None, None, "00000012"]
    assert codecs.bytes_of(base64="YQ==") == b"a" and binascii.crc32(b"") == 0 and codecs.identity("a", "b") != codecs.identity("ab") != codecs.identity("ab", domain="fork")


# ---- operators ------------------------------------------------------------------------------


def test_small_operators(spark):
    queue = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    assert [r.name for r in views.orphans(queue, queue.where("n = 1")).collect()] == ["b"]
    want = spark.createDataFrame([("x", "f"), ("y", "g"), ("z", "h")], "name string, field string")
    have = spark.createDataFrame([("y", "old"), ("z", "h"), ("w", "f")], "name string, field string")
    assert sorted((r.name, r.action) for r in views.spec_changes(want, have).collect()) == [("w", "drop"), ("x", "create"), ("y", "swap")]
    changes = spark.createDataFrame([("a", 1, None, True), ("b", 1, "v", False), ("c", 0, None, False)], "key string, kind int, value string, elided boolean")
    now = spark.createDataFrame([("a", "now"), ("b", "other")], "key string, value string")
    assert sorted((r.key, r.value) for r in views.current_values(changes, now).collect()) == [("a", "now"), ("b", "v"), ("c", None)]
    with pytest.raises(Exception, match="fewer records"):
        views.fold(spark.createDataFrame([("g", -1, 5)], "c string, orders int, n long"), "c", "n").collect()
    ops = spark.createDataFrame([(k * 37 % 1000 + 5,) for k in range(1000)], "ord long")
    rows = txn.assign_seqnos(ops, 50, parts=7).orderBy("ord").collect()
    assert [r.seqno for r in rows] == list(range(51, 1051)) and {r.commit_seqno for r in rows} == {1050}
    assert txn.assign_seqnos(ops.limit(0), 5).count() == 0
