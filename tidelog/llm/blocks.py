"""Documents dealt into blocks of a few MB, and sorted sets of 64-bit keys in few bytes.

A block's documents travel together, compressed, and each key that a block holds is counted
within it first: a key that every document holds then arrives once a block, and no group grows
with one key's frequency. Keys are dealt by their top bits (buckets); both numbers follow from
the data alone, so any task can be rerun.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20


def pack_docs(ids: list[int | None], texts: list[bytes]) -> bytes:
    """Ids and texts as one compressed value."""
    head = np.array([len(ids)], dtype="<i8").tobytes()
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    numbers = np.array([i or 0 for i in ids], dtype="<i8")
    sizes = np.array([len(t) for t in texts], dtype="<i8")
    return zstandard.compress(b"".join((head, known.tobytes(), numbers.tobytes(), sizes.tobytes(), *texts)), 1)


def unpack_docs(blobs) -> tuple[list[int | None], list[bytes]]:
    """The documents of all these values, sorted, so that their order doesn't depend on that of the values."""
    rows = []
    for blob in blobs:
        data = zstandard.decompress(bytes(blob))
        n = int(np.frombuffer(data, "<i8", 1)[0])
        known = np.frombuffer(data, np.uint8, n, 8)
        numbers = np.frombuffer(data, "<i8", n, 8 + n).tolist()
        ends = np.cumsum(np.frombuffer(data, "<i8", n, 8 + 9 * n)) + 8 + 17 * n
        starts = np.concatenate(([8 + 17 * n], ends[:-1]))
        rows += [(i if k else None, data[a:b]) for k, i, a, b in zip(known, numbers, starts.tolist(), ends.tolist())]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


class Layout:
    """How many blocks and buckets a corpus takes."""

    def __init__(self, docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES):
        total = docs.select(F.sum(F.octet_length(f"`{text_col}`").cast("long")).alias("n")).first().n or 0
        self.blocks = max(1, -(-total // block_bytes))

    def bucket_bits(self, a_block: float, least: int, most: int = 20) -> int:
        """Bits of a bucket's number for about so many buckets a block, within limits."""
        return min(most, max(least, int(self.blocks * a_block).bit_length()))

    def deal(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(block int, blob binary): the rows of docs, several to a blob; null text is empty."""
        text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
        rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.blocks)).cast("int").alias("block"), "doc_id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = batch.column(0).to_numpy()
                ids, texts = batch.column(1), batch.column(2)
                order = np.argsort(block, kind="stable")
                cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                    mine = pa.array(order[a:b])
                    blob = pack_docs(ids.take(mine).to_pylist(), texts.take(mine).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([int(block[order[a]])], pa.int32()), pa.array([blob], pa.binary())], names=["block", "blob"])

        return rows.mapInArrow(run, "block int, blob binary")


def pack(keys: np.ndarray) -> bytes:
    """Sorted unique uint64 keys as the first key and differences of one width."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype=np.uint64)
    width = blob[0]
    raw = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(raw) + 1, 8), dtype=np.uint8)
    gaps[0] = np.frombuffer(blob, dtype=np.uint8, count=8, offset=1)
    gaps[1:, :width] = raw
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def cuts(keys: np.ndarray, bits: int, of: int = 64) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) for the buckets that sorted keys of `of` bits fall into by their top bits; none is visited in vain."""
    bucket = keys >> np.uint64(of - bits)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.empty(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield int(bucket[a]), a, b
