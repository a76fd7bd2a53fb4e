"""Byte-level BPE through a sentencepiece model serialised straight from the rank table.

Every byte is one private character, so every token of the vocabulary is one piece; a piece
scores minus its rank, so the merge that sentencepiece prefers is the one of lowest rank, the
leftmost of equals. The normaliser is the identity. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

#: One letter for each byte, none of which sentencepiece treats specially.
ALPHABET = "".join(chr(0x100 + b) for b in range(256))
#: A worker keeps the ids of this many pre-tokens and of as many cuts; then it starts anew. Longer pre-tokens aren't kept.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 48
#: Texts of so many characters are looked up together and leave as one batch.
GROUP_CHARS = 2_000_000
#: A word of Latin letters, and one mark after it at most: two pre-tokens that need no search.
MARKS = ".,;:!?"
_word = re.compile(rf"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([{MARKS}]?)").fullmatch


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank table of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & ((1 << 64) - 1))


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece k has rank k, one unknown piece follows the last.

    Raises ValueError when ranks aren't 0..n-1 or a single byte lacks a token.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0..n-1, each once")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a token")
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = codecs.charmap_decode(token, "strict", ALPHABET)[0].encode()
        out += _block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, normal))
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))
    normalizer = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return bytes(out) + _block(2, trainer) + _block(3, normalizer)


class Codec:
    """Encodes and decodes texts with one vocabulary and one pre-token pattern.

    With chunked, a text is cut before each single space that has no white space beside it: for a
    pattern in which such a space always opens a pre-token (as in public_tokenizers.PATTERN) the
    pre-tokens of the cuts are those of the text, and the ids of frequent cuts are kept.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunked: bool = False):
        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.findall = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(ranks))
        self.chunked = chunked
        self.pretokens: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}
        self.marks = {m: ranks[m.encode()].to_bytes(4, "little") for m in MARKS}

    def _ids(self, pretokens: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pretokens]
        mapped = [codecs.charmap_decode(r, "strict", ALPHABET)[0] for r in raw]
        known = self.ranks.get
        return [array("I", [whole] if (whole := known(r)) is not None else ids).tobytes() for r, ids in zip(raw, self.pieces.encode(mapped, num_threads=1))]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, pre-token by pre-token."""
        split = [self.findall(t) for t in texts]
        ids = self.pretokens
        wanted = set().union(*split)
        new = [p for p in wanted if p not in ids]
        if len(ids) + len(new) > CACHE_ENTRIES:
            ids.clear()
            new = list(wanted)
        ids.update(zip(new, self._ids(new)))
        out = [b"".join(map(ids.__getitem__, pretokens)) for pretokens in split]
        for p in new:
            if len(p) > CACHE_CHARS:
                del ids[p]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.chunked:
            return self._joined(texts)
        split = [t.split(" ") for t in texts]
        ids = self.chunks
        wanted = set().union(*(chunks[1:] for chunks in split))
        new = [c for c in wanted if c not in ids]
        if len(ids) + len(new) > CACHE_ENTRIES:
            ids.clear()
            new = list(wanted)
        # most are one word with or without a mark after it: those need no pattern
        plain, marked, other = set(), [], []
        for c in new:
            if m := _word(c):
                stem, mark = m.groups()
                plain.add(stem)
                if mark:
                    marked.append((c, stem, mark))
            elif c and not c[0].isspace() and not c[-1].isspace():
                other.append(c)
            else:
                ids[c] = None
        plain.difference_update(ids)
        stems = list(plain)
        ids.update(zip(stems, self._ids([" " + c for c in stems])))
        ids.update(zip(other, self._joined([" " + c for c in other])))
        for c, stem, mark in marked:
            ids[c] = ids[stem] + self.marks[mark]
        # the first chunk has no space before it; a text with a cut beside white space is taken whole
        out: list[bytes | None] = []
        for chunks, first in zip(split, self._joined([chunks[0] for chunks in split])):
            try:
                sound = len(chunks) == 1 or (chunks[0] and not chunks[0][-1].isspace())
                out.append(b"".join((first, *map(ids.__getitem__, chunks[1:]))) if sound else None)
            except TypeError:
                out.append(None)
        whole = [k for k, b in enumerate(out) if b is None]
        for k, b in zip(whole, self._joined([texts[k] for k in whole])):
            out[k] = b
        for c in new:
            if len(c) > CACHE_CHARS:
                del ids[c]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary: bytes, pattern: str, chunked: bool) -> Codec:
    key = hashlib.sha256(b"%d" % chunked + vocabulary + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}, pattern, chunked)
    return _CODECS[key]


def _grouped(texts: list[str | None]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size > GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, chunked: bool = False) -> DataFrame:
    """Adds n_tokens long, token_ids array<int>, ids_sha256 and decoded_sha256 string to the rows.

    Null text is empty text: no tokens, the digests of nothing. keep names the columns to carry
    (default: all); a carried column with the name of a new one gives way to it. Repeated rows
    are encoded each; an empty table gives an empty table. The vocabulary (about 1 MB, its size
    fixed by the file) travels with the code. chunked is faster, but only right for a pattern
    in which a single space before a word always opens a pre-token (see Codec).
    """
    with open(vocab_path, "rb") as f:
        vocabulary = f.read()
    new = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256")
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # columns travel under names of our own, the text once more beside them, so that no name matters and keep needn't have it
    names = [f"c{i}" for i in range(len(carried))]
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern, chunked)
        for batch in batches:
            at = 0
            for group in _grouped(batch.column(len(carried)).to_pylist()):
                ids = codec.encode_all(group)
                counts = [len(b) // 4 for b in ids]
                offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
                part = batch.slice(at, len(group))
                at += len(group)
                columns = [part.column(i) for i in range(len(carried))] + [
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))),
                    pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                    pa.array([hashlib.sha256(codec.decode(b)).hexdigest() for b in ids]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    out = source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *added]))
    return out.select(*(F.col(n).alias(c) for c, n in zip(carried, names)), *new)


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """Adds out_col, the text of each row's ids (bytes that aren't UTF-8 become U+FFFD); null ids give null."""
    with open(vocab_path, "rb") as f:
        vocabulary = f.read()

    @F.pandas_udf("string")
    def to_text(column):
        codec = _codec(vocabulary, ".", False)
        return column.map(lambda ids: None if ids is None else codec.decode(np.asarray(ids, dtype="<u4").tobytes()).decode("utf-8", "replace"))

    return encoded.withColumn(out_col, to_text(F.col(ids_col)))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir)
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], chunked=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
