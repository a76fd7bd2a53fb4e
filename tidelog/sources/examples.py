"""Modules that come with the engine, to install in a store. Exit codes are stated with each."""

from __future__ import annotations

import json
import re
import struct
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import codecs
from tidelog.operators import views
from tidelog.sources.modules import Fail, Module

U64 = (1 << 64) - 1


def _text(column: str = "key"):
    return F.decode(F.col(column), "UTF-8")


def _near(txn, prefix: str, ids: DataFrame) -> DataFrame:
    """A scan of prefix/<id> from the least of the ids (a text column id) to the greatest, so that a step reads what lies near its events."""
    span = ids.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    lo = prefix.encode()
    return txn.scan(lo, lo) if span.a is None else txn.scan(lo + span.a.encode(), lo + span.b.encode() + b"\x00")


# ---- queries --------------------------------------------------------------------------------


def _agg(view, args) -> dict:
    """Numbers (the first eight bytes of values) under a prefix. 2: empty prefix."""
    prefix = (args or {}).get("prefix") or ""
    if not prefix:
        raise Fail(2, "a prefix is needed")
    rows = view.scan_prefix(prefix.encode()).select(codecs.decode_u64_le(F.col("value")).alias("n"))
    return {k: int(v) for k, v in views.numeric_summary(rows).first().asDict().items()}


def _top_customers(view, args) -> list[dict]:
    """Customers by total, then name; limit 10 unless given, 100 at most, none below 1. Records that aren't sound are left out."""
    args = args or {}
    limit = 10 if args.get("limit") is None else args["limit"]
    if limit <= 0:
        return []
    record = F.from_json(_strict("value"), "orders decimal(20,0), totalCents decimal(20,0)")
    rows = view.scan_prefix(b"customers/").select(F.substr(_strict("key"), F.lit(11)).alias("customer"), record.alias("r")).where("customer IS NOT NULL AND r IS NOT NULL")
    stats = rows.select("customer", F.coalesce("r.orders", F.lit(0)).alias("orders"), F.coalesce("r.totalCents", F.lit(0)).alias("total"))
    top = views.top_customers(stats, limit, int(args.get("minTotalCents") or 0)).orderBy("rank")
    return [{"customer": r.customer, "orders": int(r.orders), "totalCents": int(r.total), "avgCents": int(r.total) // int(r.orders)} for r in top.collect()]


def _strict(column: str):
    """A binary column as text, null where it isn't UTF-8."""
    return F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string"))


# ---- executors ------------------------------------------------------------------------------


def _place_order(txn, args) -> dict:
    """2: arguments; 3: customer; 4: amount; 5: note; 7: counter or statistics aren't sound."""
    args = args or {}
    customer, note = args.get("customer"), args.get("note")
    try:
        amount = int(args["amountCents"])
        if not isinstance(customer, str) or not (note is None or isinstance(note, str)) or not 0 <= amount <= U64:
            raise ValueError
    except (KeyError, TypeError, ValueError):
        raise Fail(2, "customer, amountCents and note are read") from None
    if not re.fullmatch(r"[a-z0-9_-]{1,64}", customer):
        raise Fail(3, "a customer has 1 to 64 of a-z, 0-9, _ and -")
    if amount == 0:
        raise Fail(4, "the amount must be positive")
    if note is not None and len(note.encode()) > 256:
        raise Fail(5, "the note is over 256 bytes")
    raw = txn.get_for_update(b"orders/next")
    if raw is not None and not re.fullmatch(rb"\d{1,20}", raw):
        raise Fail(7, "the counter isn't a number")
    number = 1 if raw is None else int(raw)
    stat = f"customers/{customer}".encode()
    orders, total = _counts(txn.get_for_update(stat))
    orders, total = orders + 1, total + amount
    if number >= U64 or total > U64:
        raise Fail(7, "numbers are used up")
    txn.put(b"orders/next", str(number + 1).encode())
    txn.put(f"orders/{number:08}".encode(), json.dumps({"id": number, "customer": customer, "amountCents": amount, "note": note}).encode())
    txn.put(stat, json.dumps({"orders": orders, "totalCents": total}).encode())
    return {"id": number, "customer": customer, "amountCents": amount, "customerOrders": orders, "customerTotalCents": total}


def _counts(raw: bytes | None) -> tuple[int, int]:
    if raw is None:
        return 0, 0
    try:
        found = json.loads(raw)
        orders, total = found["orders"], found["totalCents"]
        if all(type(x) is int and 0 <= x <= U64 for x in (orders, total)):
            return orders, total
    except (ValueError, TypeError, KeyError):
        pass
    raise Fail(7, "the customer's statistics aren't sound")


def _transfer(txn, args) -> dict:
    """1: too little; 2: arguments; 3: unknown account. Both balances are read first and the target is written last."""
    try:
        source, target, amount = args["from"].encode(), args["to"].encode(), int(args["amount"])
        if not 0 <= amount <= U64:
            raise ValueError
    except (KeyError, TypeError, ValueError, AttributeError):
        raise Fail(2, "from, to and amount are read") from None
    have, held = txn.get_for_update(source), txn.get_for_update(target)
    if have is None or held is None or len(have) < 8 or len(held) < 8:
        raise Fail(3, "unknown account")
    have, held = (struct.unpack_from("<Q", x)[0] for x in (have, held))
    if have < amount:
        raise Fail(1, "insufficient funds")
    left, got = have - amount, held + amount & U64
    txn.put(source, struct.pack("<Q", left))
    txn.put(target, struct.pack("<Q", got))
    return {"from": left, "to": got}


def _claim(txn, args) -> dict:
    """1: taken by another; 2: arguments."""
    names = [(args or {}).get(k) for k in ("username", "owner")]
    if not all(isinstance(n, str) and 1 <= len(n) <= 64 and "/" not in n and n.isascii() for n in names):
        raise Fail(2, "username and owner have 1 to 64 ASCII characters without slashes")
    key = f"uname/{names[0]}".encode()
    holder = txn.get_for_update(key)
    if holder is not None and holder != names[1].encode():
        raise Fail(1, f"{names[0]} is taken")
    if holder is None:
        txn.put(key, names[1].encode())
    return {"username": names[0], "owner": names[1], "already": holder is not None}


# ---- triggers -------------------------------------------------------------------------------


def _checked(column, bad, message: str):
    """column, the query failing where bad holds."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(column)


def _customer_index(txn, keys: DataFrame) -> None:
    """For touched orders the postings idx/customer/<customer>/<id>, the old one found by the back-pointer idx/order/<id>. A record without a sound customer fails."""
    ids = txn.computed(keys.select(codecs.key_segment(_text(), "orders/", r"\d{8}").alias("id"), _text().alias("k")).where("id IS NOT NULL AND length(k) = 15").select("id"))
    now = _near(txn, "orders/", ids).select(F.substr(_text(), F.lit(8)).alias("id"), F.get_json_object(_text("value"), "$.customer").alias("c"), F.lit(1).alias("there"))
    sound = F.col("c").isNotNull() & (F.col("c") != "") & ~F.col("c").contains("/")
    back = _near(txn, "idx/order/", ids).select(F.substr(_text(), F.lit(11)).alias("id"), _text("value").alias("old"))
    rows = ids.join(now, "id", "left").join(back, "id", "left")
    rows = rows.select("id", "old", _checked(F.col("c"), F.col("there").isNotNull() & ~sound, "an order without a sound customer").alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    entry = lambda c: F.concat(F.lit("idx/customer/"), c, F.lit("/"), F.col("id"))
    op = lambda key, value: F.struct(key.cast("binary").alias("key"), value.cast("binary").alias("value"))
    ops = F.array_compact(F.array(F.when(F.col("old").isNotNull(), op(entry(F.col("old")), F.lit(None))), F.when(F.col("new").isNotNull(), op(entry(F.col("new")), F.lit(""))), op(F.concat(F.lit("idx/order/"), F.col("id")), F.col("new"))))
    txn.write_frame(rows.select(F.explode(ops).alias("o")).select("o.*"))


def _order_feed(txn, changes: DataFrame) -> None:
    """An entry feed/<seqno> for each change of an order, in commit order. A record that isn't JSON fails."""
    order = codecs.key_segment(_text(), "orders/", r"\d{8}")
    rows = changes.select(order.alias("id"), "seqno", "kind", "elided", _text("value").alias("record"), F.octet_length("key").alias("n")).where("id IS NOT NULL AND n = 15")
    parsed = F.try_parse_json("record")
    broken = (F.col("kind") == 1) & ~F.col("elided") & parsed.isNull()
    head = F.concat(F.lit('{"seqno":'), F.col("seqno").cast("string"), F.lit(',"op":"'), F.when(F.col("kind") == 1, "put").otherwise("delete"), F.lit('","id":"'), F.col("id"), F.lit('"'))
    tail = F.when(F.col("kind") != 1, "}").when(F.col("elided"), ',"record":null,"elided":true}').otherwise(F.concat(F.lit(',"record":'), F.col("record"), F.lit("}")))
    value = _checked(F.concat(head, tail), broken, "an order that isn't JSON")
    txn.write_frame(rows.select(F.concat(F.lit("feed/"), codecs.padded(F.col("seqno"), 20)).cast("binary").alias("key"), value.cast("binary").alias("value")))


def _newest(changes: DataFrame, prefix: str) -> DataFrame:
    """The last change of each key with a prefix in a step: (id, kind, value, elided)."""
    rows = changes.where(F.startswith(_text(), F.lit(prefix)))
    return rows.groupBy("key").agg(F.max_by(F.struct("kind", "value", "elided"), "seqno").alias("v")).select("key", "v.*").withColumn("id", F.substr(_text(), F.lit(len(prefix) + 1)))


def _dynamic_index(txn, changes: DataFrame) -> None:
    """Indexes idx/<name>/<value>/<id> of rec/<id> by the field that idxspec/<name> names: made, swapped and torn down as specs change. A bad spec or record fails."""
    specs = txn.scan_prefix(b"idxspec/").select(F.substr(_text(), F.lit(9)).alias("name"), F.get_json_object(_text("value"), "$.field").alias("field"))
    specs = specs.withColumn("field", _checked(F.col("field"), F.col("field").isNull() | (F.col("field") == ""), "an index spec without a field"))
    active = txn.scan_prefix(b"idxcur/").select(F.substr(_text(), F.lit(8)).alias("name"), _text("value").alias("field"))
    moved = {r.name: r for r in views.spec_changes(specs, active).collect()}  # a row a spec
    want = {r.name: r.field for r in specs.collect()}
    touched = txn.computed(_newest(changes, "rec/").select("id"))
    some = not touched.isEmpty()
    wide = lambda rows: rows.select(F.substr(_text(), F.lit(5)).alias("id"), _text("value").alias("json"))
    op = lambda key, value: F.struct(key.cast("binary").alias("key"), value.cast("binary").alias("value"))
    none = F.lit(None).cast("binary")
    parts: list[DataFrame] = []
    for name, change in moved.items():
        if change.action != "create":
            parts += [txn.scan_prefix(prefix.encode()).select("key", none.alias("value")) for prefix in (f"idx/{name}/", f"idxptr/{name}/")]
    for name, spec in want.items():
        value = _checked(codecs.index_value(F.col("json"), spec), F.try_parse_json("json").isNull(), "a record that isn't JSON").alias("new")
        entry = lambda c, name=name: F.concat(F.lit(f"idx/{name}/"), c, F.lit("/"), F.col("id"))
        pointer = F.concat(F.lit(f"idxptr/{name}/"), F.col("id"))
        if name in moved:
            rows = wide(txn.scan_prefix(b"rec/")).select("id", value).where("new IS NOT NULL")
            ops = F.array(op(entry(F.col("new")), F.lit("")), op(pointer, F.col("new")))
        elif some:
            now = wide(_near(txn, "rec/", touched)).join(touched, "id", "left_semi").select("id", value)
            back = _near(txn, f"idxptr/{name}/", touched).select(F.substr(_text(), F.lit(len(f"idxptr/{name}/") + 1)).alias("id"), _text("value").alias("old"))
            rows = touched.join(now, "id", "left").join(back, "id", "left").where(~F.col("old").eqNullSafe(F.col("new")))
            ops = F.array_compact(F.array(F.when(F.col("old").isNotNull(), op(entry(F.col("old")), none)), F.when(F.col("new").isNotNull(), op(entry(F.col("new")), F.lit(""))), op(pointer, F.col("new"))))
        else:
            continue
        parts.append(rows.select(F.explode(ops).alias("o")).select("o.*"))
    if parts:
        turns = [rows.select("key", "value", F.lit(k).alias("turn")) for k, rows in enumerate(parts)]
        last = reduce(DataFrame.union, turns).groupBy("key").agg(F.max_by(F.struct("value"), "turn").alias("v"))  # one operation a key
        txn.write_frame(last.select("key", "v.value"))
    for name, change in moved.items():
        key = f"idxcur/{name}".encode()
        txn.delete(key) if change.action == "drop" else txn.put(key, change.field.encode())


def _live_stats(txn, changes: DataFrame) -> None:
    """stat/<customer> (orders, cents) kept up from changes of ord/<id>; fold/<id> remembers what was counted. A negative group fails."""
    newest = txn.computed(_newest(changes, "ord/").select("key", "kind", "value", "elided", "id"))
    left_out = newest.where("elided").agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    held = txn.scan(bytes(left_out.a), bytes(left_out.b) + b"\x00") if left_out.a is not None else txn.scan(b"ord/", b"ord/")
    now = views.current_values(newest, held.select("key", "value"))
    record = F.from_json(_text("value"), "customer string, cents long")
    new = now.select("id", F.when((F.col("kind") == 1) & F.col("value").isNotNull(), record).alias("new"), "kind", "value")
    new = new.withColumn("new", _checked(F.col("new"), (F.col("kind") == 1) & F.col("value").isNotNull() & (F.col("new.customer").isNull() | F.col("new.cents").isNull()), "an order that isn't sound"))
    counted = _near(txn, "fold/", newest).select(F.substr(_text(), F.lit(6)).alias("id"), record.alias("old"))
    both = txn.computed(new.join(counted, "id", "left").select("id", "old", "new"))
    part = lambda c, sign: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["customer"].alias("id"), F.lit(sign).alias("orders"), (F.col(c)["cents"] * sign).alias("cents")))
    moves = both.select(F.explode(F.array_compact(F.array(part("old", -1), part("new", 1)))).alias("m")).select("m.*")
    sums = txn.computed(moves.groupBy("id").agg(F.sum("orders").alias("more"), F.sum("cents").alias("much")))
    stats = _near(txn, "stat/", sums).select(F.substr(_text(), F.lit(6)).alias("id"), F.from_json(_text("value"), "orders int, cents long").alias("s"))
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    after = sums.join(stats, "id", "left").select("id", add(F.col("s.orders"), F.col("more")).alias("orders"), add(F.col("s.cents"), F.col("much")).alias("cents"))
    bad = (F.col("orders") < 0) | (F.col("cents") < 0)
    value = F.when(F.col("orders") != 0, codecs.json_object(orders=F.col("orders"), cents=F.col("cents")))
    txn.write_frame(after.select(F.concat(F.lit("stat/"), "id").cast("binary").alias("key"), _checked(value, bad, "a group below zero").cast("binary").alias("value")))
    fold = F.when(F.col("new").isNotNull(), F.to_json("new"))
    txn.write_frame(both.where("new IS NOT NULL OR old IS NOT NULL").select(F.concat(F.lit("fold/"), "id").cast("binary").alias("key"), fold.cast("binary").alias("value")))


def _cascade_delete(txn, changes: DataFrame) -> None:
    """When doc/<id> is deleted, everything below doc/<id>/ goes, as it is when the trigger is drained."""
    rest = F.substr(_text(), F.lit(5))
    gone = changes.where((F.col("kind") == 0) & F.startswith(_text(), F.lit("doc/")) & (rest != "") & ~rest.contains("/")).select(rest.alias("id")).distinct()
    below = txn.scan_prefix(b"doc/").select("key", F.substr(_text(), F.lit(5)).alias("rest")).where(F.col("rest").contains("/"))
    found = below.withColumn("id", F.substring_index("rest", "/", 1)).join(gone, "id", "left_semi")
    txn.write_frame(found.select("key", F.lit(None).cast("binary").alias("value")))


EXAMPLES: dict[str, Module] = {
    "agg": Module(query=_agg),
    "topCustomers": Module(query=_top_customers, describe={
        "kind": "query", "args": {"limit": "Int", "minTotalCents": "U64"}, "output": "[CustomerStat!]!",
        "types": {"CustomerStat": {"customer": "String!", "orders": "U64!", "totalCents": "U64!", "avgCents": "U64!"}},
    }),
    "placeOrder": Module(execute=_place_order, describe={
        "kind": "execute", "args": {"customer": "String!", "amountCents": "U64!", "note": "String"}, "output": "PlacedOrder!",
        "types": {"PlacedOrder": {"id": "U64!", "customer": "String!", "amountCents": "U64!", "customerOrders": "U64!", "customerTotalCents": "U64!"}},
    }),
    "transfer": Module(execute=_transfer),
    "claim": Module(execute=_claim),
    "customer_index": Module(on_touch=_customer_index),
    "order_feed": Module(on_apply=_order_feed, describe={
        "feed": {"prefix": "feed/", "event": "OrderEvent!"}, "types": {"OrderEvent": {"seqno": "U64!", "op": "String!", "id": "String!", "record": "Json", "elided": "Boolean"}},
    }),
    "dynamic_index": Module(on_apply=_dynamic_index),
    "live_stats": Module(on_apply=_live_stats),
    "cascade_delete": Module(on_apply=_cascade_delete),
}
