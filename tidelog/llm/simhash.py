"""SimHash near-duplicates: fingerprints, and a self-join of the binary trie of fingerprints.

The trie is walked by pairs of nodes, from the pair (root, root) down to the pairs of leaves:
from a pair at one depth to the pairs of their children, adding one for each bit that differs,
dropping pairs beyond the budget. To spread the walk, the 64 bits are cut into blocks, more
than the budget by `agree`: two fingerprints within the budget agree on `agree` blocks at
least, so in one of the tries that begin with these blocks they hang under the same node at
that depth, and the walks below such nodes are independent. How many blocks agree follows from
the number of fingerprints, so that such a node has few leaves and each fingerprint is sent to
as many nodes as there are tries, whatever the size of the corpus. A node that is crowded all
the same is walked in parts: pairs of its descendants some levels down, within the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, graph, jaccard

SEED = 42
#: Leaves that a node at which walks begin should have at most; one with more is walked in parts.
CHUNK = 4096
#: A crowded node is walked by pairs of its descendants so many levels down.
LEVELS = 6
#: Rows that one walk takes at a time (it always takes whole units) and node pairs expanded at once.
BATCH_ROWS, PAIRS = 32_768, 400_000


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype=">u8")
    for at in range(0, len(values), 65536):
        ones += np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in common.binary_values(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


# ---- the walk -----------------------------------------------------------------------------


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root with every i and j in one class; classes are named by their least member."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def trie_links(unit: np.ndarray, keys: np.ndarray, budget: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each position the least position that it is linked to, through links within its unit.

    unit must be sorted, keys sorted in each unit. The walk starts from the pair (root, root)
    of every unit's trie; in a unit with two sides (side 0 before side 1, keys sorted in each) from
    the pair of the tries of its sides.
    """
    n = len(keys)
    root = np.arange(n)
    if n < 2:
        return root
    part = unit if side is None else _runs(unit) * 3 + side
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    first, last = edges[:-1], edges[1:]
    paired = np.zeros(len(first), dtype=bool) if side is None else np.append(part[first][1:] == part[first][:-1] + 1, False) & (side[first] == 0)
    alone = (last - first > 1) & (True if side is None else side[first] == 2)
    nexts = np.append(np.arange(1, len(first)), 0)
    a0, a1 = np.concatenate((first[alone], first[paired])), np.concatenate((last[alone], last[paired]))
    b0, b1 = np.concatenate((first[alone], first[nexts[paired]])), np.concatenate((last[alone], last[nexts[paired]]))
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the 1-children of nodes at this depth begin."""
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[depth][hi] - ones[depth][lo])

    stack = [(0, a0, a1, b0, b1, np.zeros(len(a0), dtype=np.int8))]
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        if len(a0) > PAIRS:
            for at in range(0, len(a0), PAIRS):
                stack.append((depth, *(x[at : at + PAIRS] for x in (a0, a1, b0, b1, bits))))
            continue
        if not len(a0):
            continue
        if depth == 64:  # what has come so far is within the budget; equal fingerprints of two sides are one leaf each
            root = _unite(root, np.minimum(a0, b0), np.maximum(a0, b0))
            continue
        am, bm = split(depth, a0, a1), split(depth, b0, b1)
        same = a0 == b0  # a node paired with itself
        parts = ((a0, am, b0, bm, bits, None), (am, a1, bm, b1, bits, None), (a0, am, bm, b1, bits + np.int8(1), None), (am, a1, b0, bm, bits + np.int8(1), ~same))
        grown = [[] for _ in range(5)]
        for p0, p1, q0, q1, d, mask in parts:
            ok = (p1 > p0) & (q1 > q0) & (d <= budget)
            if mask is not None:
                ok &= mask
            for x, y in zip(grown, (p0, p1, q0, q1, d)):
                x.append(y[ok])
        joined = tuple(np.concatenate(x) for x in grown)
        # a leaf paired with itself, or leaf pairs with both ends in one class already, add nothing
        lone = (joined[1] - joined[0] == 1) & (joined[3] - joined[2] == 1)
        keep = ~(lone & (root[joined[0]] == root[joined[2]]))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in joined)))
    return root


def _runs(values: np.ndarray) -> np.ndarray:
    """The number of each run of equal values."""
    return np.cumsum(np.concatenate(([0], values[1:] != values[:-1])))


def _tables(budget: int, agree: int) -> list[list[tuple[int, int]]]:
    """For each rearranged trie the (offset, width) of the blocks in order, the agreeing ones first."""
    n = budget + agree
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [[blocks[k] for k in lead] + [x for k, x in enumerate(blocks) if k not in lead] for lead in combinations(range(n), agree)]


def _rearranged(fp: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for offset, width in blocks:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(64 - offset - width)) & np.uint64((1 << width) - 1))
    return out


def agreeing(fingerprints: int, budget: int, chunk: int = CHUNK) -> int:
    """The fewest blocks whose agreement leaves chunk of so many (evenly spread) fingerprints in a node or less."""
    agree = 1
    while agree < 8 and fingerprints >> (64 * agree // (budget + agree)) > chunk:
        agree += 1
    return agree


def _walk(budget: int, agree: int):
    tables = _tables(budget, agree)

    def links(unit: np.ndarray, table: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        keys = np.empty(len(fp), dtype=np.uint64)
        for k in np.unique(table):
            mine = table == k
            keys[mine] = _rearranged(fp[mine], tables[k])
        order = np.lexsort((keys, side, unit))
        root = trie_links(unit[order], keys[order], budget, side[order])
        moved = np.flatnonzero(root != np.arange(len(root)))
        values = fp[order].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for x, c in zip(held, batch.columns):
                x.append(c.to_numpy(zero_copy_only=False))
            if sum(map(len, held[0])) < BATCH_ROWS:
                continue
            unit, table, side, fp = map(np.concatenate, held)
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut:
                yield links(unit[:cut], table[:cut], side[:cut], fp[:cut].view(np.uint64))
            held = [[unit[cut:]], [table[cut:]], [side[cut:]], [fp[cut:]]]
        if held[0]:
            unit, table, side, fp = map(np.concatenate, held)
            yield links(unit, table, side, fp.view(np.uint64))

    return run


def _bits(fp: Column, blocks: list[tuple[int, int]], start: int, width: int) -> Column:
    """Bits start .. start + width of a rearranged fingerprint, as a long."""
    out, passed = F.lit(0).cast("long"), 0
    for offset, size in blocks:
        a, b = max(start, passed), min(start + width, passed + size)
        if a < b:
            at, n = offset + a - passed, b - a
            out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned(F.shiftleft(fp, at), 64 - n))
        passed += size
    return out


def links(prints: DataFrame, budget: int = 4, agree: int | None = None, chunk: int = CHUNK, levels: int = LEVELS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that span, as a forest in each walk, all links within budget.

    prints has one column fp long without repeats. The bits are cut into budget + agree blocks,
    of which two linked fingerprints share agree at least (default: as many as the number of
    fingerprints asks for). Below a node with more than chunk leaves, walks begin at the pairs
    of its descendants `levels` down that differ in no more bits than the budget: a
    fingerprint goes to as many of them as there are such patterns of bits.
    """
    fp = F.col("fp")
    agree = agreeing(prints.count(), budget, chunk) if agree is None else agree
    tables = _tables(budget, agree)
    depth = [sum(width for _, width in blocks[:agree]) for blocks in tables]
    keys = F.array(*(F.struct(F.lit(k).alias("table"), _bits(fp, blocks, 0, depth[k]).alias("node"), _bits(fp, blocks, depth[k], levels).alias("below")) for k, blocks in enumerate(tables)))
    placed = prints.select(fp, F.explode(keys).alias("k")).select("fp", "k.*")
    crowded = placed.groupBy("table", "node").count().where(F.col("count") > chunk).select("table", "node", F.lit(True).alias("crowded"))
    split = placed.join(crowded, ["table", "node"], "left")
    # a crowded node: the descendant itself, and with each other descendant near it the pair, whose lesser one is side 0
    patterns = F.array(*(F.lit(x) for x in range(1 << levels) if x.bit_count() <= budget))
    near = F.transform(patterns, lambda x: F.struct(F.least(F.col("below"), F.col("below").bitwiseXOR(x)).alias("lo"), x.cast("long").alias("bits"),
                                                    F.when(x == 0, 2).when(F.col("below") < F.col("below").bitwiseXOR(x), 0).otherwise(1).alias("side")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("bits"), F.lit(2).alias("side")))
    units = split.select("fp", "table", "node", F.explode(F.when(F.col("crowded"), near).otherwise(whole)).alias("u"))
    units = units.select(F.xxhash64("table", "node", "u.lo", "u.bits").alias("unit"), "table", "u.side", "fp")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_walk(budget, agree), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, agree: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) per row: component_id is the least id reachable over links.

    Texts without words have fingerprint zero and link like others; null text counts as empty.
    Rows with a null id are fingerprinted and link others; they get their component's least id,
    null if it has none. Repeated rows stay. An empty table gives an empty table.
    """
    prints = common.materialize(fingerprints(docs, shingle, id_col, text_col), "prints")
    least = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints-least")
    found = common.materialize(links(least.select("fp"), budget, agree), "prints-links")
    roots = common.materialize(graph.components(found), "roots")
    common.discard(found)
    linked = roots.join(least, roots.node == least.fp).select("fp", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(names, "root").select(F.col("node").alias("fp"), "component_id")
    classes = least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return common.spread_join(prints, classes, ["fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies (Jaccard similarity of 0.8 or more, verified) of a document that stays: of each component the row of least id.

    Candidates within budget bits come from the links of the trie of fingerprints alone. As no
    small budget holds the 0.8 line, the pairs beyond it, and no others, come from shared rare
    shingles; each is verified, so the links kept span all pairs of 0.8 or more and no others.
    Rows without words, or with a null id, stay all. Of rows with equal ids and equal texts one
    stays; rows with equal ids and other texts are documents of their own. Columns may have any names. Empty in, empty out.
    """
    text = F.col(f"`{text_col}`")
    found = jaccard.components(docs.where(text.rlike(common.WORD)).select(id_col, text_col), shingle, id_col, text_col, lambda prints: links(prints, budget), budget)
    found = common.materialize(found.where("doc_id is not null").groupBy("doc_id", "text_hash", "component_id").agg(F.count("*").alias("rows")), "found")
    # of the rows that bear their component's id the one of least text hash stays: ids needn't be unique
    first = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("first"))
    marks = common.spread_join(found, first, ["component_id"]).select("doc_id", "text_hash", ((F.col("doc_id") != F.col("component_id")) | (F.col("text_hash") != F.col("first"))).alias("gone"), (F.col("rows") > 1).alias("again"))
    marks = common.materialize(marks.where("gone or again"), "marks")
    keyed = docs.select(common.row_of(docs), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.rlike(common.WORD).alias("worded"))
    # most rows aren't marked, and half a megabyte tells most of them: only the others are dealt out to be joined
    keyed = common.perhaps_in(keyed, "hash", marks, "text_hash", "perhaps")
    rest = keyed.where(~F.col("perhaps")).select("row")
    joined = keyed.where("perhaps").join(marks, F.col("worded") & (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left").where(~F.coalesce("gone", F.lit(False)))
    again = F.coalesce("again", F.lit(False))
    once = joined.where(again).dropDuplicates(["id", "hash"]).select("row")
    return rest.unionByName(joined.where(~again).select("row")).unionByName(once).select("row.*")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir), shingle=4, budget=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
