"""Secret scan with corpus-wide ownership of candidates.

Base rules give assign, access and hex spans. Beyond them, any long token that mixes letters
and digits is a candidate. Candidates are hashed, and the hashes aggregated over the corpus by
distinct owners and distinct repositories: a value that many owners hold is a copied example,
one that stays with one owner is owner-specific and, if it looks random, live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

# The base patterns and the least lengths of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more, as [0-9a-f]+ filtered by length gives
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "token")

#: What the method adds: runs of these characters, so long or longer, of so many bits a character.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
LEAST_BITS = 3.0
#: From so many owners on a value is a widely copied example.
EXAMPLE_OWNERS = 3


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_BITS


def find(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Base spans and candidate tokens of a text as (start, kind, end, secret value)."""
    base = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    base += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    base += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base.sort()
    inside = [(s, e) for s, _, e, _ in base]
    more = [(m.start(), 3, m.end(), m[0]) for m in TOKEN.finditer(text) if looks_live(m[0]) and not any(s < m.end() and m.start() < e for s, e in inside)]
    return base, more


SPANS = "array<struct<start: int, kind: int, end: int, hash: long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "little", signed=True)


def candidates(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, owner, repository, spans) per row: base spans and candidates with the hash of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column(4):
                base, more = find(value.as_py() or "")
                spans.append([{"start": s, "kind": k, "end": e, "hash": _hash(v)} for s, k, e, v in base + more])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spans, _SPAN)], names=["doc_id", "text_hash", "owner", "repository", "spans"])

    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), text.alias("text"))
    return source.mapInArrow(run, f"doc_id long, text_hash long, owner string, repository string, spans {SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, example boolean) of every candidate value; null owners count as one; none gives none."""
    each = found.select(F.explode("spans.hash").alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    pairs = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    counts = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return counts.withColumn("example", F.col("owners") >= EXAMPLE_OWNERS)


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, found array<struct<start, kind, end, example>>) for every row.

    found has the base spans, and those candidate tokens that are owner-specific; example says
    that EXAMPLE_OWNERS owners or more hold the value. owner defaults to the column source,
    repository to source and lang. Positions are code points, end exclusive. Null text is empty;
    rows with equal ids stay rows of their own; an empty table gives an empty table.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = common.materialize(candidates(docs, owner, repository, id_col, text_col), "secrets")
    counts = ownership(found)
    # rows alike in id and text have the same spans, so one answer serves them
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("text_hash").alias("t")]
    some = found.where(F.size("spans") > 0).select(*key, "spans").dropDuplicates(["k", "t"])
    each = common.materialize(some.select("k", "t", F.explode("spans").alias("s")).select("k", "t", "s.start", "s.kind", "s.end", "s.hash"), "secret-spans")
    spans = common.spread_join(each, counts.select("hash", "example"), ["hash"])
    spans = spans.where((F.col("kind") < 3) | ~F.col("example"))
    kept = spans.groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "example"))).alias("found"))
    rows = common.spread_join(found.select("doc_id", "text_hash", *key), kept, ["k", "t"], "left")
    return rows.select("doc_id", "text_hash", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean>>")).alias("found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with every found value that isn't a widely copied example replaced by mark; other columns and rows as they were.

    Null text stays null; spans that overlap give one mark; rows alike in id and text are
    treated alike; columns may have any names; empty in, empty out.
    """
    found = scan(docs, id_col=id_col, text_col=text_col).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"), F.filter("found", lambda s: ~s["example"]).alias("spans"))
    found = common.materialize(found.where(F.size("spans") > 0).dropDuplicates(["id", "hash"]), "secret-found")
    text = F.col(f"`{text_col}`")
    keyed = docs.select(common.row_of(docs), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("k"), F.xxhash64(text).alias("t"))
    joined = keyed.join(found, (F.col("k") == F.col("id")) & (F.col("t") == F.col("hash")), "left")
    text = F.col("row")[text_col]
    # the text between the spans, each span giving what lies between the end of those before it and its start
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        new = F.greatest(s["at"], x["end"])
        gap = F.substr(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        add = F.when(x["start"] >= s["at"], F.concat(gap, F.lit(mark))).otherwise("")
        return F.struct(F.concat(s["out"], add).alias("out"), new.alias("at"))

    clean = F.aggregate("spans", state, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    clean = F.when(F.col("spans").isNull(), text).otherwise(clean)
    return joined.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan(common.documents(spark, sf_dir))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(named(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), named(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~s["example"])).cast("long").alias("n_owner_specific"), F.size(F.filter("found", lambda s: s["example"])).cast("long").alias("n_copied"),
    )
