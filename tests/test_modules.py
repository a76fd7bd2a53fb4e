import json
import struct
import time

import pytest

from tidelog import errors
from tidelog.sources import modules
from tidelog.sources.examples import EXAMPLES
from tidelog.sources.modules import Fail, Module
from tidelog.sources.store import DELETE, PUT, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"file://{tmp_path}/main", "main")


def state(store, prefix=b""):
    return {bytes(r.key): bytes(r.value) for r in store.scan_prefix(prefix).collect()}


def j(**fields):
    return json.dumps(fields).encode()


def test_roles_and_installing(store):
    store.install("agg", EXAMPLES["agg"])
    store.write([(PUT, b"m/%d" % k, struct.pack("<Q", k * 7)) for k in range(5)] + [(PUT, b"m/short", b"x")])
    assert store.query("agg", {"prefix": "m/"}) == {"count": 6, "summed": 5, "sum": 70, "min": 0, "max": 28}
    with pytest.raises(errors.GuestFailed) as failed:
        store.query("agg", {"prefix": ""})
    assert failed.value.exit_code == 2
    for call in (lambda: store.execute("agg"), lambda: store.query("none"), lambda: store.install("x", Module()), lambda: store.install("no/name", EXAMPLES["agg"]), lambda: store.uninstall("none")):
        with pytest.raises(errors.InvalidArgument):
            call()
    before = store.snapshot()
    store.install("agg", Module(query=lambda view, args: "new"))
    assert store.query("agg") == "new"
    # code and data are those of one seqno
    assert store.query("agg", {"prefix": "m/"}, before)["count"] == 6
    store.uninstall("agg")
    assert store.modules().count() == 0 and [r.name for r in store.modules(before).collect()] == ["agg"]
    with pytest.raises(errors.InvalidArgument):
        store.query("agg")


def test_queries_cannot_write_and_swallowed_errors_fail(store):
    def writes(view, args):
        view.put(b"k", b"v")

    def swallows(view, args):
        try:
            view.put(b"k", b"v")
        except errors.StoreError:
            return "fine"

    def locks(txn, args):
        try:
            txn.get(b"")
        except errors.StoreError:
            txn.put(b"k", b"v")

    for name, module in {"w": Module(query=writes), "s": Module(query=swallows)}.items():
        store.install(name, module)
        with pytest.raises(errors.InvalidArgument):
            store.query(name)
    store.install("l", Module(execute=locks))
    with pytest.raises(errors.InvalidArgument):
        store.execute("l")
    assert store.get(b"k") is None

    def fails(txn, args):
        txn.put(b"k", b"v")
        raise Fail(0, "no")

    def breaks(txn, args):
        raise KeyError("x")

    store.install("f", Module(execute=fails))
    store.install("b", Module(execute=breaks))
    for name in "fb":
        with pytest.raises(errors.GuestFailed) as failed:
            store.execute(name)
        assert failed.value.exit_code == 1
    assert store.get(b"k") is None


def test_typed_output_and_arguments(store):
    bad = Module(execute=lambda txn, args: txn.put(b"done", b"1") or {"n": "x"}, describe={"kind": "execute", "output": "Out!", "types": {"Out": {"n": "Int!"}}})
    store.install("bad", bad)
    with pytest.raises(errors.OutputViolation) as wrong:
        store.execute("bad")
    assert wrong.value.committed and store.get(b"done") == b"1"
    d = modules.Descriptor.parse({"kind": "query", "args": {"a": "[Int!]", "b": "U64!"}, "output": "[T!]!", "types": {"T": {"x": "Int", "y": "[String]", "z": "U64"}}}, "m", ["query"])
    assert d.normalize([{"x": 1, "extra": 2, "z": 18446744073709551615}]) == [{"x": 1, "y": None, "z": "18446744073709551615"}]
    for value in (None, [None], [{"x": 1 << 31}], [{"x": True}], [{"y": "s"}], [{"z": -1}], {"x": 1}):
        with pytest.raises(ValueError):
            d.normalize(value)
    assert d.arguments({"a": 4, "b": "7"}) == {"a": [4], "b": "7"} and d.arguments({"b": 1})["a"] is None
    for given in ({}, {"b": 1, "c": 2}, {"b": "x"}, {"a": [None], "b": 1}):
        with pytest.raises(errors.InvalidArgument):
            d.arguments(given)
    for raw in ({}, {"kind": "query"}, {"kind": "x", "output": "Int"}, {"kind": "query", "output": "[[Int]]"}, {"kind": "query", "output": "Nope"}, {"kind": "execute", "output": "Int"}, {"feed": {"prefix": "", "event": "Int"}}, {"args": {"a": "Int"}, "feed": {"prefix": "p", "event": "Int"}}):
        with pytest.raises(errors.InvalidArgument):
            modules.Descriptor.parse(raw, "m", ["query"])
    for name in ("get", "9x", "__x"):
        with pytest.raises(errors.InvalidArgument):
            modules.Descriptor.parse({"kind": "query", "output": "Int"}, name, ["query"])


def test_orders_customers_claims_and_transfers(store):
    for name in ("placeOrder", "topCustomers", "claim", "transfer"):
        store.install(name, EXAMPLES[name])
    place = lambda customer, cents, note=None: store.execute("placeOrder", {"customer": customer, "amountCents": cents, "note": note})
    place("acme", 5000)
    assert place("acme", 2500) == {"id": "2", "customer": "acme", "amountCents": "2500", "customerOrders": "2", "customerTotalCents": "7500"}
    place("zenith", 9000)
    store.put(b"customers/bad", b"{")
    assert store.query("topCustomers") == [{"customer": "zenith", "orders": "1", "totalCents": "9000", "avgCents": "9000"}, {"customer": "acme", "orders": "2", "totalCents": "7500", "avgCents": "3750"}]
    assert [r["customer"] for r in store.query("topCustomers", {"minTotalCents": 8000})] == ["zenith"] and store.query("topCustomers", {"limit": 0}) == []
    codes = {}
    for args in ({"customer": "a"}, {"customer": "A", "amountCents": 1}, {"customer": "a", "amountCents": 0}, {"customer": "a", "amountCents": 1, "note": "n" * 257}, {"customer": "bad", "amountCents": 1}):
        with pytest.raises(errors.GuestFailed) as failed:
            store.execute("placeOrder", args)
        codes[json.dumps(args)[:60]] = failed.value.exit_code
    assert list(codes.values()) == [2, 3, 4, 5, 7]
    claim = lambda owner: store.execute("claim", {"username": "neo", "owner": owner})
    assert claim("a")["already"] is False and claim("a")["already"] is True
    with pytest.raises(errors.GuestFailed) as failed:
        claim("b")
    assert failed.value.exit_code == 1
    store.write([(PUT, b"acct/%d" % k, struct.pack("<Q", 10)) for k in range(2)])
    send = lambda a, b, n: store.execute("transfer", {"from": a, "to": b, "amount": n})
    assert send("acct/0", "acct/1", 4) == {"from": 6, "to": 14} and send("acct/0", "acct/0", 1) == {"from": 5, "to": 7}
    for args, code in ((("acct/0", "acct/1", 99), 1), (("acct/0", "none", 1), 3), (("acct/0", "acct/1", -1), 2)):
        with pytest.raises(errors.GuestFailed) as failed:
            send(*args)
        assert failed.value.exit_code == code


def test_index_and_feed_triggers(store):
    for name in ("customer_index", "order_feed"):
        store.install(name, EXAMPLES[name])
        store.create_trigger(name, b"orders/", b"orders0", module=name)
    order = lambda k, customer: (PUT, b"orders/%08d" % k, j(customer=customer))
    store.write([order(1, "acme"), order(2, "bob"), (PUT, b"orders/next", b"3"), order(1, "zorg")])
    assert {r.name: r.pending for r in store.triggers().collect()} == {"customer_index": 3, "order_feed": 4}
    assert store.drain_all() == {"customer_index": 1, "order_feed": 1}
    assert set(state(store, b"idx/customer/")) == {b"idx/customer/zorg/00000001", b"idx/customer/bob/00000002"}
    feed = [json.loads(v) for _, v in sorted(state(store, b"feed/").items())]
    assert [(e["op"], e["id"], e["record"]["customer"]) for e in feed] == [("put", "00000001", "acme"), ("put", "00000002", "bob"), ("put", "00000001", "zorg")]
    assert [e["seqno"] for e in feed] == sorted(e["seqno"] for e in feed)
    # what triggers write fires none; a replay changes nothing
    assert store.drain_all() == {"customer_index": 1, "order_feed": 1} and len(state(store, b"feed/")) == 3
    store.write([(DELETE, b"orders/00000002", None)])
    store.drain("customer_index")
    assert set(state(store, b"idx/")) == {b"idx/customer/zorg/00000001", b"idx/order/00000001"}
    store.put(b"orders/00000009", j(customer="a/b"))
    with pytest.raises(Exception, match="sound"):
        store.drain("customer_index")
    t = store.manifest().triggers["customer_index"]
    assert "sound" in t["last_error"] and t["failures"] == 1 and len(t["last_error"].encode()) <= 500
    store.put(b"orders/00000009", j(customer="ab"))
    time.sleep(0.2)
    store.drain("customer_index")
    assert store.manifest().triggers["customer_index"]["last_error"] is None and b"idx/customer/ab/00000009" in state(store, b"idx/")


def test_dynamic_index(store):
    store.install("dyn", EXAMPLES["dynamic_index"])
    store.create_trigger("rec", b"rec/", b"rec0", module="dyn")
    store.create_trigger("spec", b"idxspec/", b"idxspec0", module="dyn")
    index = lambda: {k.decode().removeprefix("idx/byc/") for k in state(store, b"idx/")}
    store.write([(PUT, b"rec/1", j(c="acme", n=5)), (PUT, b"rec/2", j(c="bob", n=6)), (PUT, b"rec/3", j(n=1)), (PUT, b"idxspec/byc", j(field="c"))])
    store.drain_all()
    assert index() == {"acme/1", "bob/2"}
    store.write([(PUT, b"rec/1", j(c="zorg")), (DELETE, b"rec/2", None), (PUT, b"rec/3", j(c="acme", n=9))])
    store.drain_all()
    assert index() == {"zorg/1", "acme/3"}
    store.put(b"idxspec/byc", j(field="n"))
    store.drain_all()
    assert index() == {"9/3"}
    store.delete(b"idxspec/byc")
    store.drain_all()
    assert index() == set() and not state(store, b"idxptr/") and not state(store, b"idxcur/")


def test_live_stats_and_cascades(store):
    store.install("live", EXAMPLES["live_stats"])
    store.install("cascade", EXAMPLES["cascade_delete"])
    store.create_trigger("live", b"ord/", b"ord0", module="live")
    store.create_trigger("cascade", b"doc/", b"doc0", module="cascade")
    order = lambda k, customer, cents: (PUT, b"ord/%03d" % k, j(customer=customer, cents=cents))
    stats = lambda: {k.decode()[5:]: json.loads(v) for k, v in state(store, b"stat/").items()}
    store.write([order(1, "acme", 500), order(2, "bob", 120), order(3, "acme", 990)])
    store.drain("live")
    assert stats() == {"acme": {"orders": 2, "cents": 1490}, "bob": {"orders": 1, "cents": 120}}
    store.write([order(1, "bob", 1000), (DELETE, b"ord/003", None)])
    store.drain("live", batch=1)
    assert stats() == {"bob": {"orders": 2, "cents": 1120}}
    store.write([(PUT, b"doc/a", b""), (PUT, b"doc/a/1", b""), (PUT, b"doc/a/2/x", b""), (PUT, b"doc/b", b""), (PUT, b"doc/b/1", b"")])
    store.write([(DELETE, b"doc/b/1", None), (DELETE, b"doc/a", None)])
    store.put(b"doc/a/late", b"")  # written before the drain: it goes too
    store.drain("cascade")
    assert set(state(store, b"doc/")) == {b"doc/b"}
