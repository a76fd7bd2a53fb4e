"""AVI motion-JPEG media columns: payloads stored in JPEG coefficients, shots from histograms of decoded frames.

A payload is cut into frames; each frame is a complete grey baseline JPEG in a '00dc' chunk,
listed in the 'idx1' index. JPEG samples are lossy, its quantised coefficients aren't, so a
byte is one AC coefficient (128..255 for itself, -255..-128 for 0..127), 32 a block. Reading
goes by the RIFF structure and the index, and decodes every frame: Huffman codes by the tables
that it carries (or the standard ones), then dequantisation and the inverse DCT. The payload
comes from the coefficients, the histograms from the luminance. Baseline frames of other
writers are read as well, with one component or several, any sampling and restart markers.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

UNIT = 64
#: Coefficients used in a block, blocks in a row and rows in a frame: 512 payload bytes a frame.
USED, ACROSS, DOWN = 32, 4, 4
BLOCKS = ACROSS * DOWN
FRAME = USED * BLOCKS
MS = 40  # a frame lasts so long
#: Histogram bins; a cut is a difference above the mean of the shot so far by so many deviations, and above a floor.
BINS, DEVIATIONS, FLOOR = 16, 3.0, 0.35


def pad(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of 64."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


# ---- writing --------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    quant = _segment(0xDB, b"\x00" + b"\x01" * 64)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + b"\x01\x11\x00")
    # codes of eight bits: DC 00 = no difference; AC 00 = an eight-bit coefficient next, 01 = end of block
    eight = lambda kind, symbols: _segment(0xC4, bytes([kind, *(0,) * 7, len(symbols), *(0,) * 8]) + bytes(symbols))
    return b"\xff\xd8" + quant + frame + eight(0x00, [0x00]) + eight(0x10, [0x08, 0x00]) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


HEAD, END = _head(), b"\xff\xd9"


def _blocks(payload: bytes) -> bytes:
    values = np.frombuffer(payload, dtype=np.uint8).reshape(-1, USED)
    out = np.zeros((len(values), 2 * USED + 2), dtype=np.uint8)
    out[:, 2 : 2 * USED + 1 : 2] = values
    out[:, -1] = 1
    return out.tobytes()


def jpeg(payload: bytes) -> bytes:
    """One frame of up to 512 bytes, a multiple of 32; blocks without payload are empty."""
    scan = _blocks(payload) + b"\x00\x01" * (BLOCKS - len(payload) // USED)
    return HEAD + scan.replace(b"\xff", b"\xff\x00") + END


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write(payload: bytes) -> bytes:
    """The AVI file of a padded payload."""
    frames = [jpeg(payload[at : at + FRAME]) for at in range(0, len(payload), FRAME)]
    width, height, n = 8 * ACROSS, 8 * DOWN, len(frames)
    largest = max(map(len, frames))
    main = struct.pack("<14I", MS * 1000, 0, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, MS, 1000, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    sizes = np.array([len(f) for f in frames], dtype="<u4")
    index = np.zeros((n, 4), dtype="<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # a key frame
    index[:, 2] = 4 + np.concatenate(([0], np.cumsum([len(c) for c in chunks])[:-1]))
    index[:, 3] = sizes
    return b"RIFF" + struct.pack("<I", 4 + len(head) + sum(map(len, chunks)) + 12 + 8 + 16 * n) + b"AVI " + head + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", index.tobytes())


# ---- reading --------------------------------------------------------------------------------


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks between two places; a list has its kind as its name."""
    while at + 8 <= min(end, len(data)):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield (data[at + 8 : at + 12] if name in (b"LIST", b"RIFF") else name), at + 8, size
        at += 8 + size + (size & 1)


def _is_video(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db")


def _walked(data: bytes, start: int, end: int) -> Iterator[bytes]:
    """The video frames of a movi list without an index, in order; they may lie in 'rec ' lists."""
    for name, at, size in _chunks(data, start, end):
        if name == b"rec ":
            yield from _walked(data, at + 4, at + size)
        elif _is_video(name):
            yield data[at : at + size]


def read_frames(data: bytes) -> tuple[list[bytes], int]:
    """The video frames that the index lists (without an index, those of the movi list), and the microseconds that each lasts.

    An empty entry repeats the frame before. ValueError if it isn't an AVI file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    parts = {name: (at, size) for name, at, size in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0])}
    if b"movi" not in parts or b"hdrl" not in parts:
        raise ValueError("an AVI file needs hdrl and movi")
    micros = struct.unpack_from("<I", data, parts[b"hdrl"][0] + 12)[0]
    base, length = parts[b"movi"]
    if b"idx1" in parts:
        at, size = parts[b"idx1"]
        entries = [(name, o, n) for name, _, o, n in struct.iter_unpack("<4sIII", data[at : at + size // 16 * 16]) if _is_video(name)]
        # places count from the kind of the movi list, or from the start of the file
        if entries and data[base + entries[0][1] : base + entries[0][1] + 4] != entries[0][0]:
            base = 0
        found = [data[base + o + 8 : base + o + 8 + n] for _, o, n in entries]
    else:
        found = list(_walked(data, base + 4, base + length))
    frames: list[bytes] = []
    for f in found:
        if f or frames:
            frames.append(f or frames[-1])
    return frames, micros


# The Huffman tables of frames that carry none (numbers of codes of each length, symbols), and the order of coefficients.
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: ("0002010303020403050504040000017d",
           "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
           "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6"
           "c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    0x11: ("00020102040403040705040400010277",
           "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
           "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
           "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
}
#: Row and column of each coefficient: along the antidiagonals, up and down in turn.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def _basis() -> np.ndarray:
    """For each coefficient in zigzag order the 64 samples that it adds, for coefficient 1."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    wave = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.array([np.outer(wave[r], wave[c]).ravel() for r, c in ZIGZAG], dtype=np.float32)


BASIS = _basis()


class _Huffman:
    """A table as a lookup of 16 bits: the symbol and the length of its code; length 0 where no code begins so."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                low = code << (16 - length)
                self.symbol[low : low + (1 << (16 - length))], self.length[low : low + (1 << (16 - length))] = s, length
                code += 1
            at += n
            code <<= 1
        self.lengths = {i for i, n in enumerate(counts, 1) if n}
        self.symbols = set(symbols)
        self.pairs = (self.length.astype(np.int32) << 8 | self.symbol).tolist()


@dataclass
class _Part:
    """A component: its sampling, quantisation and Huffman tables, and how many blocks it has down and across."""

    h: int
    v: int
    quant: np.ndarray
    dc: _Huffman
    ac: _Huffman
    down: int
    across: int


@dataclass
class _Head:
    high: int
    wide: int
    parts: list[_Part]
    units: tuple[int, int]  # coded units down and across
    restart: int

    @property
    def aligned(self) -> bool:
        """Whether all codes are bytes and all coded coefficients are bytes without zeros before them."""
        p = self.parts[0]
        return len(self.parts) == 1 and not self.restart and p.dc.lengths == p.ac.lengths == {8} and p.dc.symbols == {0} and p.ac.symbols <= {0, 8}


_PARSED: dict[bytes, _Head] = {}


def _tables(body: bytes) -> Iterator[tuple[int, _Huffman]]:
    at = 0
    while at < len(body):
        n = sum(body[at + 1 : at + 17])
        yield body[at], _Huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
        at += 17 + n


def _quants(body: bytes) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while at < len(body):
        wide = body[at] >> 4
        yield body[at] & 15, np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.float32)
        at += 1 + 64 * (1 + wide)


def _head_of(head: bytes) -> _Head:
    """What the segments up to the scan say."""
    if head in _PARSED:
        return _PARSED[head]
    at, quants, restart, frame = 2, {}, 0, None
    tables = {}
    while at + 4 <= len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of eight bits are read")
            frame = high, wide, [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(n)]
        elif marker == 0xC4:
            tables.update(_tables(body))
        elif marker == 0xDB:
            quants.update(_quants(body))
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("baseline frames are read")
        elif marker == 0xDA:
            uses = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if frame is None or set(uses) != {c for c, _, _ in frame[2]}:
        raise ValueError("one scan of all components is read")
    for k, (counts, symbols) in STANDARD.items():
        if k not in tables:
            tables[k] = _Huffman(bytes.fromhex(counts), bytes.fromhex(symbols))
    high, wide, listed = frame
    most_h, most_v = max(hv >> 4 for _, hv, _ in listed), max(hv & 15 for _, hv, _ in listed)
    alone = len(listed) == 1
    units = (-(-high // 8), -(-wide // 8)) if alone else (-(-high // (8 * most_v)), -(-wide // (8 * most_h)))
    parts = []
    for c, hv, q in listed:
        h, v = (1, 1) if alone else (hv >> 4, hv & 15)
        parts.append(_Part(h, v, quants[q], tables[uses[c] >> 4], tables[0x10 | uses[c] & 15], units[0] * v, units[1] * h))
    if len(_PARSED) > 64:
        _PARSED.clear()
    _PARSED[head] = _Head(high, wide, parts, units, restart)
    return _PARSED[head]


def _split(frame: bytes) -> tuple[bytes, bytes]:
    """The segments of a frame up to its scan, and the scan."""
    if frame.startswith(HEAD):
        start = len(HEAD)
    else:
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        at = 2
        while at + 4 <= len(frame) and frame[at + 1] != 0xDA:
            at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
        if at + 4 > len(frame):
            raise ValueError("a frame without a scan")
        start = at + 2 + struct.unpack_from(">H", frame, at + 2)[0]
    end = frame.rfind(END)
    return frame[:start], frame[start : end if end >= start else len(frame)]


def _scan(head: _Head, scan: bytes) -> list[np.ndarray]:
    """For each component the coefficients (down, across, 64), zigzag order, code by code."""
    out = [np.zeros((p.down, p.across, 64), dtype=np.int32) for p in head.parts]
    stretches = re.split(rb"\xff[\xd0-\xd7]", scan) if head.restart else [scan]
    order = [(out[k], p, dv, dh) for k, p in enumerate(head.parts) for dv in range(p.v) for dh in range(p.h)]
    total = head.units[0] * head.units[1]
    for k, stretch in enumerate(stretches):
        first = k * head.restart
        last = min(total, first + head.restart) if head.restart else total
        data = stretch.replace(b"\xff\x00", b"\xff")
        have = len(data) * 8
        data += bytes(8)
        at = 0  # the next bit

        def peek16() -> int:
            byte = at >> 3
            return (int.from_bytes(data[byte : byte + 3], "big") >> (8 - (at & 7))) & 0xFFFF

        def value(size: int) -> int:
            nonlocal at
            if not size:
                return 0
            v = peek16() >> (16 - size)
            at += size
            return v if v >> (size - 1) else v - (1 << size) + 1

        dc = {id(plane): 0 for plane in out}
        for unit in range(first, last):
            down, across = divmod(unit, head.units[1])
            for plane, p, dv, dh in order:
                pair = p.dc.pairs[peek16()]
                at += pair >> 8
                dc[id(plane)] += value(pair & 15)
                block = plane[down * p.v + dv, across * p.h + dh]
                block[0] = dc[id(plane)]
                n = 1
                while n < 64:
                    pair = p.ac.pairs[peek16()]
                    if not pair >> 8 or at > have:
                        raise ValueError("no such code, or the scan ends early")
                    at += pair >> 8
                    run, size = pair >> 4 & 15, pair & 15
                    if not size and run < 15:
                        break
                    n += run
                    if size:
                        if n > 63:
                            raise ValueError("a block has 64 coefficients")
                        block[n] = value(size)
                    n += 1
        if at > have:
            raise ValueError("the scan ends early")
    return out


def coefficients(frame: bytes) -> list[np.ndarray]:
    """For each component of a frame its quantised coefficients: blocks down, blocks across, 64 in zigzag order."""
    head, scan = _split(frame)
    return _scan(_head_of(head), scan)


def _levels(coded: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """The samples (n, 64) of blocks (n, m) of their first m coefficients: dequantised, transformed back, rounded and clipped."""
    m = coded.shape[1]
    samples = coded.astype(np.float32) @ (BASIS[:m] * quant[:m, None])
    np.rint(samples, out=samples)
    samples += 128
    return np.clip(samples, 0, 255, out=samples).astype(np.uint8)


def luminance(frame: bytes) -> np.ndarray:
    """The first component of a decoded frame, which is its luminance, as an array of rows."""
    head, scan = _split(frame)
    head = _head_of(head)
    part = head.parts[0]
    blocks = _levels(_scan(head, scan)[0].reshape(-1, 64), part.quant).reshape(part.down, part.across, 8, 8)
    most_h, most_v = max(p.h for p in head.parts), max(p.v for p in head.parts)
    high, wide = -(-head.high * part.v // most_v), -(-head.wide * part.h // most_h)
    return blocks.swapaxes(1, 2).reshape(8 * part.down, 8 * part.across)[:high, :wide]


def _aligned(frames: list[bytes]) -> tuple[_Head, np.ndarray] | None:
    """The coefficients of frames whose codes and values are all whole bytes, all frames at once: (blocks, m), DC first.

    Codes go through the frame's tables; blocks have one number of coefficients, up to empty ones at the end. None if
    frames differ in their tables or aren't of that kind: then they are decoded code by code.
    """
    split = [_split(f) for f in frames]
    if not split or any(h != split[0][0] for h, _ in split):
        return None
    head = _head_of(split[0][0])
    if not head.aligned:
        return None
    part = head.parts[0]
    dc, ac = (np.where(t.length[::256] == 8, t.symbol[::256], 255) for t in (part.dc, part.ac))
    data = np.frombuffer(b"".join(x for _, x in split).replace(b"\xff\x00", b"\xff"), dtype=np.uint8)
    n = len(frames) * part.down * part.across
    first = ac[data[1 : 2 * 64 : 2]]  # the codes of the first block, if it goes on so long
    m = int(np.argmax(first == 0)) if (first == 0).any() else -1
    if m < 0:
        return None
    size = 2 * m + 2
    full = (len(data) - 2 * n) // (2 * m) if m else 0
    body, rest = data[: full * size], data[full * size :]
    if len(rest) != 2 * (n - full) or dc[rest[0::2]].any() or ac[rest[1::2]].any():
        return None
    body = body.reshape(-1, size)
    if dc[body[:, 0]].any() or ac[body[:, -1]].any() or not (ac[body[:, 1:-1:2]] == 8).all():
        return None
    coded = np.zeros((n, 1 + m), dtype=np.int16)
    values = body[:, 2:-1:2].astype(np.int16)
    coded[:full, 1:] = np.where(values >> 7, values, values - 255)
    return head, coded


def _bytes(coded: np.ndarray) -> bytes:
    """The payload that blocks of coefficients hold: one byte each, from the first AC on; zero isn't one."""
    values = coded[:, 1:]
    values = values[values != 0]
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()


def _decoded(frames: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The payload of the frames of a file that write made, and each frame's histogram of luminance."""
    if (fast := _aligned(frames)) is not None:
        head, coded = fast
        return _bytes(coded), _histograms(_levels(coded, head.parts[0].quant).reshape(len(frames), -1))
    payload = b"".join(_bytes(coefficients(f)[0].reshape(-1, 64)) for f in frames)
    return payload, histograms(frames)


def read(data: bytes) -> bytes:
    """The payload of a file that write made, from the coefficients of its frames."""
    return _decoded(read_frames(data)[0])[0]


# ---- shots ----------------------------------------------------------------------------------


def _histograms(levels: np.ndarray) -> np.ndarray:
    """(frames, BINS): the shares of the levels in each row of samples."""
    owner = np.arange(len(levels), dtype=np.int32)[:, None] * BINS
    counts = np.bincount((owner + (levels >> (8 - BINS.bit_length() + 1))).ravel(), minlength=len(levels) * BINS)
    return counts.reshape(-1, BINS) / levels.shape[1]


def histograms(frames: list[bytes]) -> np.ndarray:
    """The luminance histogram of each frame."""
    if not frames:
        return np.empty((0, BINS))
    if (fast := _aligned(frames)) is not None:
        head, coded = fast
        return _histograms(_levels(coded, head.parts[0].quant).reshape(len(frames), -1))
    return np.concatenate([_histograms(luminance(f).reshape(1, -1)) for f in frames])


def differences(histogram: np.ndarray) -> np.ndarray:
    """Half the absolute difference of the histograms of each frame and the one before; 0 for the first."""
    return np.concatenate((np.zeros(min(1, len(histogram))), np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2))


def shots(change: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frames of each shot. A frame opens a shot if its change exceeds the floor and
    the mean of the changes in the shot so far by DEVIATIONS of their deviation."""
    out, first, n, total, squares = [], 0, 0, 0.0, 0.0
    for k in range(1, len(change)):
        x = float(change[k])
        mean = total / n if n else 0.0
        spread = max(0.0, squares / n - mean * mean) ** 0.5 if n else 0.0
        if x > max(FLOOR, mean + DEVIATIONS * spread):
            out.append((first, k - 1))
            first, n, total, squares = k, 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + x, squares + x * x
    return [*out, (first, len(change) - 1)] if len(change) else []


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, avi binary) per row: the text's UTF-8 bytes as an AVI file. Null text is
    empty (one frame of 64 zero bytes); repeated rows give equal files; empty in, empty out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = list(common.binary_values(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "avi"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, avi binary")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def clips(files: DataFrame, id_col: str = "doc_id", avi_col: str = "avi") -> DataFrame:
    """(doc_id, clip int, first_frame, last_frame int, start_ms, end_ms long): one row a shot of
    each file, whoever wrote it. A null or empty file has no shots; a broken one raises; repeated rows have each
    their own; empty in, empty out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "clip", "first_frame", "last_frame", "start_ms", "end_ms"]
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                if not (data := value.as_py()):
                    continue
                frames, micros = read_frames(data)
                for k, (a, b) in enumerate(shots(differences(histograms(frames)))):
                    rows.append((doc_id.as_py(), k, a, b, a * micros // 1000, (b + 1) * micros // 1000))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return files.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{avi_col}`")).mapInArrow(run, "doc_id long, clip int, first_frame int, last_frame int, start_ms long, end_ms long")


def _digest(text: bytes) -> tuple:
    data = write(pad(text))
    frames, _ = read_frames(data)
    payload, histogram = _decoded(frames)
    cut = shots(differences(histogram))
    feature = f"frames={len(frames)};shots={len(cut)};" + ",".join(f"{a * MS}-{(b + 1) * MS}" for a, b in cut)
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op10_avi_media(spark, sf_dir: str) -> DataFrame:
    """Writes each text as AVI, reads the file back and digests it, file by file: the media never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [_digest(t) for t in common.binary_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=[c.split()[0] for c in DIGEST.split(", ")])

    return _source(common.documents(spark, sf_dir), "doc_id", "text").mapInArrow(run, DIGEST)
