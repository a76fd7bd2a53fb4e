"""What the operators share: the word rule, scratch tables and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word rule of the operators (code points that separate words).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Drops the shuffle files of an execution when it ends, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Lets two sides dealt by one column be joined by it and more columns without another exchange. Never together with spread_join, whose parts it would undo.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: From so many groups in a task on, collected lists are sorted together rather than hashed.
HASHED_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
#: A small map of groups before the large one: of no use where nearly every row is a group.
TWO_MAPS = "spark.sql.codegen.aggregate.map.twolevel.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as the block runs."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, more: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends, and a lost executor costs nothing.

    Its shuffle files go as soon as it is written; more are settings for as long as it is
    written. `discard` deletes what is no longer needed;
    `release` deletes all that this application wrote, once the results have been taken.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"} | (more or {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize wrote for these frames; nothing may read them again."""
    for df in frames:
        delete_path(df.sparkSession, df._scratch_path)


def release(spark: SparkSession) -> None:
    """Deletes every intermediate that this application has written. Results that still read them must have been taken."""
    delete_path(spark, _own_folder(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until none is a column of df (case doesn't tell names apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_of(df: DataFrame) -> Column:
    """All columns of df as one struct, so that helper columns beside it can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there isn't one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- vectorised word hashing -------------------------------------------------------------

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[0x20, 9, 10, 11, 12, 13]] = True
#: The low k bytes of a word of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a UTF-8 text."""
    gap = _IS_GAP[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    return edges[0::2], edges[1::2]


#: Texts are hashed in pieces of about so many bytes, cut between words, so that the work arrays stay small.
PIECE = 1 << 20


def word_hashes(data: bytes, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order; another seed gives an independent one.

    Words of up to 16 bytes go through two rounds of a bijective mixer, longer ones through XXH64,
    so that no pattern of letters makes long words collide.
    """
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    if len(data) <= PIECE:
        return _hashes(data, starts, ends, seed)
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        base = int(starts[at])
        out.append(_hashes(data[base : int(ends[to - 1])], starts[at:to] - base, ends[at:to] - base, seed))
        at = to
    return np.concatenate(out)


def _hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    size = ends - starts
    eights = np.ndarray(len(data) + 9, dtype="<u8", buffer=data + bytes(16), strides=(1,))  # the eight bytes from each place on
    salt = np.uint64(seed * 0x9E6C63D0876A9A4B + 0x2545F4914F6CDD1D & (1 << 64) - 1)
    out = mix((eights[starts] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD[0] + salt)
    more = np.flatnonzero(size > 8)
    if len(more):
        out[more] = mix(out[more] * _ODD[1] + (eights[starts[more] + 8] & _LOW[np.minimum(size[more] - 8, 8)]))
        for k in more[size[more] > 16].tolist():
            out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], seed)
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words, from the words' hashes: runs of 1, 2, 4, ... words are joined and mixed at each join."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    level, out, done = words, None, 0
    for k in range(n.bit_length()):
        if n >> k & 1:
            part = level[done : done + count]
            out = part if out is None else mix(out * _ODD[1] + part)
            done += 1 << k
        if n >> (k + 1):
            level = mix(level[: -(1 << k)] * _ODD[2] + level[1 << k :])
    return mix(out + np.uint64(n))


def binary_values(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The bytes of each row of a binary column; null is empty."""
    for value in column:
        yield value.as_py() or b""


# ---- hot keys ------------------------------------------------------------------------------

#: A key with more than this share of the rows is hot, so there are at most its inverse of them; a hot key's rows go to so many tasks.
HOT_SHARE, HOT_PARTS = 1 / 1000, 64


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) to a table with unique keys, the rows of hot keys dealt over HOT_PARTS tasks.

    rows should come from a materialized table, as its keys are counted first, unless counts has
    them (key, _spread_n) for those rows that matter. The hot keys are broadcast: by their
    definition they are 1000 at most. Null keys never match. Names that begin with _spread are
    used inside.
    """
    if counts is None:
        counts = rows.groupBy(*key).agg(F.count("*").alias("_spread_n"))
    total = counts.agg(F.sum("_spread_n").alias("n")).first().n or 0
    hot = counts.where(F.col("_spread_n") > max(1000, int(total * HOT_SHARE)))
    hot = F.broadcast(materialize(hot.select(*(F.col(k).alias(f"_spread_{k}") for k in key), F.lit(True).alias("_spread_hot")), "hot-keys"))

    def marked(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in key:
            same = same & (F.col(k) == F.col(f"_spread_{k}"))
        return df.join(hot, same, "left").drop(*(f"_spread_{k}" for k in key))

    # equal rows are told apart by where they stand in the table
    numbered = marked(rows.withColumn("_spread_at", F.monotonically_increasing_id()))
    left = numbered.withColumn("_spread_part", F.when(F.col("_spread_hot"), F.pmod(F.xxhash64("_spread_at"), F.lit(HOT_PARTS))).otherwise(0).cast("int")).drop("_spread_hot", "_spread_at")
    parts = F.when(F.col("_spread_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked(table).withColumn("_spread_part", F.explode(parts)).drop("_spread_hot")
    return left.join(right, [*key, "_spread_part"], how).drop("_spread_part")


#: Bits of the map by which rows that a table can't concern are told, in pieces of 32768: half a megabyte, however large the table.
MAP_BITS, PIECE_BITS = 1 << 22, 1 << 15


def perhaps_in(rows: DataFrame, value: str, table: DataFrame, of: str, flag: str) -> DataFrame:
    """rows with flag, true for all whose hash `value` is among those of the table's column `of`, and by chance for some others.

    With more hashes than bits it tells nothing, and rows are true throughout. Null is false.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(MAP_BITS))
    pieces = table.select(place(of).alias("_at")).groupBy(F.floor(F.col("_at") / PIECE_BITS).alias("_piece")).agg(F.bitmap_construct_agg((F.col("_at") % PIECE_BITS).cast("long")).alias("_bits"))
    pieces = F.broadcast(materialize(pieces, "hash-map"))
    at = rows.withColumn("_at", place(value) % PIECE_BITS).withColumn("_of", F.floor(place(value) / PIECE_BITS))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = F.floor(byte / F.pow(F.lit(2.0), F.col("_at") % 8)) % 2 == 1
    return at.join(pieces, F.col("_of") == F.col("_piece"), "left").withColumn(flag, F.coalesce(found, F.lit(False))).drop("_at", "_of", "_piece", "_bits")
