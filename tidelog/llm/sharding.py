"""Extendible hashing into shards of bounded size.

A document's place is 60 bits of a hash of its id. The bucket of all documents splits on the
first bit if its bytes exceed the limit, and only buckets that exceed it split on. Sums are taken of
hash cells, some sixty to a shard, not of documents: every cell adds to the buckets on its path,
and a bucket stays whole if it fits and the one above it doesn't. The directory then has a slot for each
value of as many bits as the deepest bucket has, and says whose bucket it is; documents look up
their slot. Cells that are too large by themselves go on key by key, in a directory of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

HASH_BITS = 60
#: Cells are at most 2^this, and as many more bits deep than shards will be.
MOST_CELL_BITS, FINER = 30, 6
BUCKETS = "depth int, prefix long, shard_bytes long, shard_docs long"


def _place(key: Column) -> Column:
    """60 bits of an MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), _place(key).alias("h"), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("bytes"))


def buckets(cells: DataFrame, bits: int, limit: int, top: int = 0) -> tuple[DataFrame, DataFrame]:
    """The buckets (BUCKETS) that cells (cell long of `bits` bits, bytes, docs long) fall into, from depth `top` on; the cells too large by themselves.

    A bucket of one document, or one at depth HASH_BITS, can't be split and fits as it is. What
    lies above `top` doesn't fit. Each cell becomes a row a level, summed up before they are dealt.
    """
    levels = cells.select(F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("depth"), "cell", "bytes", "docs")
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    nodes = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == HASH_BITS)
    nodes = common.materialize(nodes.withColumn("fits", fits), "shard-nodes")
    full = nodes.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    under = nodes.withColumn("above", F.shiftright("prefix", 1)).join(full, ["depth", "above"], "left_semi").where("fits").drop("above")
    closed = under.unionByName(nodes.where(f"fits and depth = {top}"))
    return closed.select(F.col("depth").cast("int").alias("depth"), "prefix", "shard_bytes", "shard_docs"), nodes.where(f"not fits and depth = {bits}").select(F.col("prefix").alias("cell"))


def slots(closed: DataFrame, bits: int) -> DataFrame:
    """The directory: (slot long, depth, prefix, shard_bytes), one row for each value of `bits` bits that a bucket covers."""
    width = F.expr(f"shiftleft(1L, {bits} - depth)")
    first = F.col("prefix") * width
    return closed.select(F.explode(F.sequence(first, first + width - 1)).alias("slot"), "depth", "prefix", "shard_bytes")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", cell_bits: int | None = None) -> DataFrame:
    """(doc_id, bytes long, shard string, depth int, shard_bytes long) for every row.

    bytes is the UTF-8 length of the text (null: 0); shard is the bucket's hash prefix as depth
    binary digits ("" when all fit in one). Every shard holds at most limit bytes, except one of
    a single document, or of rows with one id, that is larger by itself. A null id is hashed as
    the empty string. An empty table gives an empty table.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    sizes = common.materialize(_sizes(docs, id_col, text_col), "shard-sizes")
    if cell_bits is None:
        total = sizes.agg(F.sum("bytes").alias("n")).first().n or 0
        cell_bits = min(MOST_CELL_BITS, (total // limit).bit_length() + FINER)
    cell = F.shiftright("h", HASH_BITS - cell_bits)
    cells = sizes.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
    closed, large = buckets(cells, cell_bits, limit)
    closed = common.materialize(closed, "shard-buckets")
    deepest = closed.agg(F.max("depth").alias("n")).first().n
    out = _placed(sizes, slots(closed, deepest), deepest) if deepest is not None else _none(sizes)
    if not large.isEmpty():
        large = common.materialize(large, "shard-large")
        rest = common.materialize(common.spread_join(sizes.withColumn("cell", cell), large, ["cell"]), "shard-rest")
        keys = rest.groupBy(F.col("h").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        deeper, _ = buckets(keys, HASH_BITS, limit, cell_bits)
        deeper = common.materialize(deeper, "shard-deeper")
        # here a slot for every value would be too many: a bucket is looked up by the prefix of each depth that occurs below a cell
        depths = deeper.groupBy(F.expr(f"shiftright(prefix, depth - {cell_bits})").alias("cell")).agg(F.collect_set("depth").alias("depths"))
        tried = common.spread_join(rest, depths, ["cell"]).withColumn("depth", F.explode("depths"))
        tried = common.materialize(tried.select("doc_id", "bytes", "depth", F.expr(f"shiftright(h, {HASH_BITS} - depth)").alias("prefix")), "shard-tried")
        out = out.unionByName(common.spread_join(tried, deeper.select("depth", "prefix", "shard_bytes"), ["depth", "prefix"]).select(*out.columns))
    digits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("doc_id", "bytes", digits.alias("shard"), "depth", "shard_bytes")


COLUMNS = ("doc_id", "bytes", "depth", "prefix", "shard_bytes")


def _placed(sizes: DataFrame, directory: DataFrame, bits: int) -> DataFrame:
    rows = sizes.withColumn("slot", F.shiftright("h", HASH_BITS - bits))
    return common.spread_join(rows, directory, ["slot"]).select(*COLUMNS)


def _none(sizes: DataFrame) -> DataFrame:
    return sizes.where("false").select("doc_id", "bytes", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.col("bytes").alias("shard_bytes"))


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows as Parquet, a folder (shard=<prefix>, "all" for the empty one) a shard.

    Rows with equal or null ids land together, repeated rows stay, null texts are of no size,
    columns may have any names but shard; an empty table writes no folder.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("a column named shard would clash with the folders")
    found = common.materialize(shard(docs, limit, id_col, text_col).groupBy("doc_id").agg(F.first("shard").alias("shard")), "shard-places")
    joined = docs.select(common.row_of(docs), F.col(f"`{id_col}`").alias("id")).join(found, F.col("id").eqNullSafe(F.col("doc_id")))
    name = F.when(F.col("shard") == "", "all").otherwise(F.concat(F.lit("p"), F.col("shard")))
    joined.select("row.*", name.alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)


#: 1 MiB of text a shard: the small tables split as well.
LIMIT = 1 << 20


def op6_extendible_shards(spark, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir), LIMIT)


ORACLE = """
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
                  CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes FROM documents),
l AS (SELECT doc_id, h, bytes, CAST(unnest(range(0, 61)) AS INTEGER) AS depth FROM d),
s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS b, count(*) AS n FROM l GROUP BY 1, 2),
o AS (SELECT doc_id, bytes, l.depth, s.prefix, s.b, row_number() OVER (PARTITION BY doc_id ORDER BY l.depth) AS r
      FROM l JOIN s ON s.depth = l.depth AND s.prefix = l.h >> (60 - l.depth) WHERE s.b <= 1048576 OR s.n = 1 OR l.depth = 60)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE right('000000000000000000000000000000000000000000000000000000000000' || bin(prefix), depth) END AS shard, depth, CAST(b AS BIGINT) AS shard_bytes FROM o WHERE r = 1
"""
