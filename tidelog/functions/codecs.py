"""Codecs between bytes, text and numbers, as Spark columns or for the driver."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument

MAX_KEY_BYTES = 16 << 10
U64 = 1 << 64


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def text_prefix_end(prefix: str) -> str | None:
    """prefix_end for text: the least string above all strings with this prefix in code point order, as UTF-8 keeps it."""
    for at in range(len(prefix) - 1, -1, -1):
        point = ord(prefix[at]) + 1
        if point <= 0x10FFFF:
            return prefix[:at] + chr(0xE000 if 0xD800 <= point <= 0xDFFF else point)
    return None


NAME = re.compile(r"[A-Za-z0-9._-]{1,64}")


def check_name(name: str, what: str = "name") -> str:
    if not NAME.fullmatch(name):
        raise InvalidArgument(f"a {what} has 1 to 64 letters, digits, dots, dashes or underscores")
    return name


def check_key(key: bytes) -> bytes:
    if not key or key[0] == 0 or len(key) > MAX_KEY_BYTES:
        raise InvalidArgument("a key has 1 to 16384 bytes and doesn't start with 00")
    return key


def in_range(key: Column, lo: object = None, hi: object = None) -> Column:
    """lo <= key < hi with open ends: a plain predicate, so that it reaches the Parquet scan."""
    out = F.lit(True)
    if lo is not None:
        out = out & (key >= F.lit(lo))
    if hi is not None:
        out = out & (key < F.lit(hi))
    return out


def decode_u64_le(value: Column) -> Column:
    """The first eight bytes as an unsigned little-endian number; null if there are fewer."""
    h = F.hex(value)
    big_endian = F.concat(*(F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)))
    return F.when(F.octet_length(value) >= 8, F.conv(big_endian, 16, 10).cast("decimal(20,0)"))


def encode_u64_be(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def encode_u64_le(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1))))


def parse_hex(text: Column) -> Column:
    """unhex that gives null for an odd length."""
    return F.when(F.length(text) % 2 == 0, F.unhex(text))


def to_base64(value: Column) -> Column:
    """Base64 without line breaks, whatever the session breaks lines at."""
    return F.translate(F.base64(value), "\r\n", "")


def padded(n: Column, width: int) -> Column:
    """At least width digits; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


SHOWN = 160


def display_key(text: Column) -> Column:
    """Text of printable ASCII, tabs and newlines in quotes, anything else and the empty key as hex; cut after 160 bytes, with the length."""
    raw = text.cast("binary")
    n = F.octet_length(raw)
    printable = text.rlike(r"\A[\x20-\x7e\n\t]+\z")
    body = F.when(printable, F.concat(F.lit('"'), F.substring(text, 1, SHOWN), F.lit('"'))).otherwise(F.concat(F.lit("hex:"), F.lower(F.substring(F.hex(raw), 1, SHOWN))))
    return F.when(n > SHOWN, F.concat(body, F.lit("… ("), n.cast("string"), F.lit(" bytes)"))).otherwise(body)


def shown(value: bytes) -> str:
    """display_key for the driver, over bytes."""
    if value and all(0x20 <= b < 0x7F or b in b"\t\n" for b in value):
        body = f'"{value[:SHOWN].decode()}"'
    else:
        body = f"hex:{value[: SHOWN // 2].hex()}"
    return f"{body}… ({len(value)} bytes)" if len(value) > SHOWN else body


def latency(seconds: float) -> str:
    micros = seconds * 1e6
    return f"({micros / 1000:.2f} ms)" if micros >= 1000 else f"({micros:.1f} µs)"


def crc32(*parts: Column) -> Column:
    """The IEEE checksum of the parts one after the other; null parts are empty."""
    return F.crc32(F.concat(*(F.coalesce(p.cast("binary"), F.lit(b"")) for p in parts)))


def parse_base64(text: Column) -> Column:
    """unbase64 that gives null for text that isn't base64 with its padding."""
    good = text.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(good, F.unbase64(text))


def bytes_of(text: str | None = None, base64: str | None = None, hex: str | None = None) -> bytes:  # noqa: A002
    """Bytes given in one of three ways."""
    given = [x for x in (text, base64, hex) if x is not None]
    if len(given) != 1:
        raise InvalidArgument("give exactly one of text, base64 and hex")
    if text is not None:
        return text.encode()
    try:
        import binascii

        return binascii.a2b_base64(base64, strict_mode=True) if base64 is not None else bytes.fromhex(_even(hex))
    except ValueError as error:
        raise InvalidArgument(f"not {'base64' if base64 is not None else 'hex'}: {error}") from None


def _even(digits: str) -> str:
    if len(digits) % 2 or not re.fullmatch("[0-9A-Fa-f]*", digits):
        raise ValueError("pairs of hex digits are read")
    return digits


def shown_bytes(value: bytes) -> dict:
    """Bytes in all ways: text only if they are UTF-8."""
    import base64

    try:
        text = value.decode()
    except UnicodeDecodeError:
        text = None
    return {"text": text, "base64": base64.b64encode(value).decode(), "hex": value.hex(), "len": len(value)}


def key_segment(key: Column, prefix: str, pattern: str = r"[^/]+") -> Column:
    """The segment of a key that follows prefix up to the next slash or the end; null if the prefix or the pattern doesn't fit."""
    rest = F.when(F.substring(key, 1, len(prefix)) == prefix, F.substring_index(F.substr(key, F.lit(len(prefix) + 1)), "/", 1))
    return F.when(rest.rlike(rf"\A(?:{pattern})\z"), rest)


def json_object(**fields: Column) -> Column:
    """A JSON object with these fields; null ones are written as null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def index_value(json: Column, field: str) -> Column:
    """A top-level JSON field fit for an index: a string as it is, a number in decimal form;
    null for other kinds, empty or over 128 bytes, or with a slash."""
    variant = F.try_parse_json(json)
    value = F.try_variant_get(variant, f"$.{field}", "string")
    kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{field}", "variant"))
    fit = (kind.isin("STRING", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL")) & (F.octet_length(value) <= 128) & (value != "") & ~value.contains("/")
    return F.when(fit, value)


def identity(*parts: str, domain: str = "root") -> str:
    """128 bits that name a store: each part is length-prefixed, the domain (root or fork) comes first."""
    digest = hashlib.sha256(f"tidelog-{domain}".encode())
    for part in parts:
        raw = part.encode()
        digest.update(len(raw).to_bytes(8, "big") + raw)
    return digest.hexdigest()[:32]


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """The number and where it ends; None if it is cut short or over 64 bits."""
    value = shift = 0
    while at < len(data) and shift < 70:
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return (value, at) if value < U64 else None
    return None


def uvarints(column: Column) -> Column:
    """The numbers of a binary column of uvarints one after the other, as decimal strings; null if it is cut short."""

    @F.pandas_udf("array<string>")
    def read(values):
        def numbers(data):
            at, out = 0, []
            while data is not None and at < len(data):
                got = read_uvarint(data, at)
                if got is None:
                    return None
                out.append(str(got[0]))
                at = got[1]
            return None if data is None else out

        return values.map(numbers)

    return read(column)


# ---- trigger inputs -------------------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    """A change as a trigger is handed it; a put's value is None when it was left out."""

    seqno: int
    key: bytes
    put: bool
    value: bytes | None = None


def pack_keys(keys: list[bytes]) -> bytes:
    return b"".join(uvarint(len(k)) + k for k in keys)


def parse_trigger_keys(data: bytes) -> list[bytes] | None:
    """The keys of pack_keys; None if the bytes aren't of that form."""
    at, out = 0, []
    while at < len(data):
        size = read_uvarint(data, at)
        if size is None or size[1] + size[0] > len(data):
            return None
        at = size[1] + size[0]
        out.append(data[size[1] : at])
    return out


_PUT, _DELETE, _ELIDED = 0, 1, 2  # fixed values: kinds of a packed change


def pack_changes(changes: list[Change]) -> bytes:
    out = bytearray(struct.pack("<I", len(changes)))
    for c in changes:
        kind = _DELETE if not c.put else _ELIDED if c.value is None else _PUT
        out += struct.pack("<QBI", c.seqno, kind, len(c.key)) + c.key
        if kind == _PUT:
            out += struct.pack("<I", len(c.value)) + c.value
    return bytes(out)


def parse_changes(data: bytes) -> list[Change] | None:
    """The changes of pack_changes; None if the bytes aren't of that form."""
    try:
        (count,), at, out = struct.unpack_from("<I", data), 4, []
        for _ in range(count):
            seqno, kind, size = struct.unpack_from("<QBI", data, at)
            at += 13
            key, at = data[at : at + size], at + size
            value = None
            if kind == _PUT:
                (n,) = struct.unpack_from("<I", data, at)
                value, at = data[at + 4 : at + 4 + n], at + 4 + n
            if at > len(data) or kind > _ELIDED:
                return None
            out.append(Change(seqno, key, kind != _DELETE, value))
        return out if at == len(data) else None
    except struct.error:
        return None


def strict_json(data: bytes | None) -> object:
    """JSON of bytes; InvalidArgument if they aren't."""
    try:
        return json.loads(data)
    except (TypeError, ValueError) as error:
        raise InvalidArgument(f"not JSON: {error}") from None
