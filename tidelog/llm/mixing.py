"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality with u from a hash of the row, so documents sorted by key
are a weighted sample without replacement. A source first takes whole epochs, then documents
in key order up to the rest of its budget. Prefix sums come in two levels - over key bands,
then within the one band where a budget ends - so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm import common

# The weights of the sources in order, repeating, and the largest number of epochs.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Bands of keys in a source.
BANDS = 4096


def quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: falls with the symbols and digits a word."""
    odd = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}[]@0123456789", ""))
    return F.when(size > 0, 1.0 / (1.0 + odd / size)).otherwise(1.0)


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from 48 bits of an MD5 of the seed, the id and the length of the text."""
    row = F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.octet_length(text), F.lit(0)).cast("string"))
    return (F.conv(F.substring(F.md5(row.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, id, size, key, row): row is the whole row."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    size = common.word_count(text)
    key = -F.log(_uniform(doc_id, text, seed)) / quality(text, size)
    return docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), doc_id.cast("long").alias("id"), size.alias("size"), key.alias("key"), common.row_of(docs))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds target double to (source string or null, source_size long), one row a source.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all
    sizes; none gets more than most times its size, and the excess goes to the others by weight,
    which ends where target = min(most * size, level * weight) for one level. The rows are one a
    source, so one task ranks them.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything = W.partitionBy()
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "capped": F.coalesce(F.sum("cap").over(filled), F.lit(0)), "capped_weight": F.coalesce(F.sum("weight").over(filled), F.lit(0.0))})
    # with the sources before a row held at their caps, this is the level of the others
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight")))
    rows = rows.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    rows = rows.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


HERE = ("key", "id", "size")


def _cuts(keyed: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """One row a source: target, epochs, the words of the fractional epoch, and where it ends: the key, id and size of
    the last row it takes from, how many rows are alike in these (ties) and the words that they give together (left)."""
    band = F.least(F.floor((1.0 - F.exp(-F.col("key"))) * BANDS), F.lit(BANDS - 1)).cast("int")
    rows = keyed.withColumn("band", band)
    bands = rows.groupBy("source", "band").agg(F.sum("size").alias("words"))
    plan = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = common.materialize(plan, "mix-plan")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    before = W.partitionBy("source").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    ahead = bands.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = ahead.alias("l").join(plan.alias("r"), same).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("l.source", "l.band", "before", "rest")
    within = rows.alias("l").join(ends.alias("r"), same & (F.col("l.band") == F.col("r.band"))).select("l.*", "before", "rest")
    # rows alike are one row with a count, so a row repeated without end is no long group
    within = within.groupBy("source", *HERE).agg(F.count("*").alias("ties"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    words = F.col("size") * F.col("ties")
    order = W.partitionBy("source").orderBy(*HERE).rowsBetween(W.unboundedPreceding, -1)
    within = within.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(words).over(order), F.lit(0)))
    last = within.where((F.col("left") > 0) & (F.col("left") <= words)).groupBy("source").agg(F.min(F.struct(*HERE, "left", "ties")).alias("cut"))
    return plan.alias("l").join(last.alias("r"), same, "left").select(F.col("l.source").alias("of"), "source_size", "target", "epochs", "rest", "cut")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size long, target double, taken long and copies int.

    size counts words (null text: 0). taken is the words that the mix takes of the row: size for
    each whole epoch, once more if the fractional epoch takes it; the document on which a
    source's budget ends gives its first words only, so that a source meets its target to a
    word. copies is taken in whole documents, that one rounded. Rows of one source, id, length
    and weight are alike: where a budget ends among them, as many as fit give all, one gives the
    rest, the others nothing. Columns of docs with the new names give way. Empty in, empty out.
    """
    keyed = _keyed(docs, seed, id_col, text_col, source_col)
    narrow = common.materialize(keyed.select("source", *HERE), "mix-keys")
    cuts = common.materialize(_cuts(narrow, weights, most), "mix-cuts")
    new = ("size", "source_size", "target", "taken", "copies")
    out = _taken(keyed, cuts)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new), *new)


def _taken(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """keyed rows with source_size, target, taken and copies."""
    # one row a source: Spark broadcasts it by its measured size or shuffles
    rows = keyed.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    cut = F.col("cut")
    here, end = F.struct(*HERE), F.struct(*(cut[c].alias(c) for c in HERE))
    at_end = cut.isNotNull() & (here == end)
    if cuts.where("cut.ties > 1").isEmpty():
        return _counted(rows, F.when(at_end, cut["left"]))
    # equal rows share the end of a budget: they are numbered, each part of them by itself and the parts in turn
    ends = common.materialize(rows.where(at_end).withColumn("part", F.spark_partition_id()), "mix-ends")
    parts = ends.groupBy("of", "part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("of").alias("of_"), F.col("part").alias("part_"), offset.alias("offset"))
    numbered = ends.withColumn("n", F.row_number().over(W.partitionBy("of", "part").orderBy("id")) - 1)
    numbered = numbered.join(parts, F.col("of").eqNullSafe(F.col("of_")) & (F.col("part") == F.col("part_")))
    rank, size = F.col("n") + F.col("offset"), F.col("size")
    share = F.greatest(F.lit(0), F.least(size, cut["left"] - rank * size))
    return _counted(rows.where(~at_end), F.lit(None).cast("long")).unionByName(_counted(numbered, share))


def _counted(rows: DataFrame, at_end: Column) -> DataFrame:
    """at_end: the words of the fractional epoch that a row gives on which its budget ends; null for other rows."""
    cut, size, rest = F.col("cut"), F.col("size"), F.col("rest")
    here, end = F.struct(*HERE), F.struct(*(cut[c].alias(c) for c in HERE))
    more = F.when(rest <= 0, 0).when(cut.isNull(), size).when(at_end.isNotNull(), at_end).when(here < end, size).otherwise(0)
    more = F.coalesce(more, F.lit(0)).cast("long")
    extra = F.when((size > 0) & (2 * more >= size), 1).otherwise(0)
    return rows.select("row", "size", "source_size", "target", (F.col("epochs") * size + more).alias("taken"), (F.col("epochs") + extra).cast("int").alias("copies"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    keyed = common.materialize(_keyed(docs, 9, "doc_id", "text", "source").select("source", *HERE, F.struct("row.doc_id").alias("row")), "mix-keys")
    cuts = common.materialize(_cuts(keyed.select("source", *HERE), WEIGHTS, MOST_EPOCHS), "mix-cuts")
    return _taken(keyed, cuts).select("row.doc_id", "size", "source_size", "target", "taken", "copies")


_WEIGHTS = ", ".join(f"{w:.1f}" for w in WEIGHTS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(octet_length(encode(text)), 0) AS bytes,
             length(text) - length(translate(text, '#*$%&|<>{{}}[]@0123456789', '')) AS odd FROM documents),
k AS (SELECT doc_id, source, size, -ln((CAST(CAST('0x' || substr(md5('9/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || CAST(bytes AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
             / (CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + CAST(odd AS DOUBLE) / size) ELSE 1.0::DOUBLE END) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
w AS (SELECT *, CAST([{_WEIGHTS}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST({MOST_EPOCHS} * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
        coalesce(sum(cap) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0) AS capped_weight
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - capped) / (all_weight - capped_weight) AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v WHERE level * weight < cap ORDER BY cap / weight, level LIMIT 1) * weight, cap)) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
q AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM p),
r AS (SELECT k.*, source_size, target, epochs, rest, rank() OVER (PARTITION BY k.source ORDER BY key, doc_id, size) AS place,
        rest - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains
      FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, min(CASE WHEN remains > 0 AND remains <= size THEN place END) OVER (PARTITION BY source) AS cut,
        min(CASE WHEN remains > 0 AND remains <= size THEN remains END) OVER (PARTITION BY source) AS last FROM r),
m AS (SELECT *, CASE WHEN rest <= 0 OR place > cut THEN 0 WHEN place = cut THEN last ELSE size END AS more FROM c)
SELECT doc_id, size, source_size, target, CAST(epochs * size + more AS BIGINT) AS taken, CAST(epochs + (size > 0 AND 2 * more >= size)::INTEGER AS INTEGER) AS copies FROM m
"""
