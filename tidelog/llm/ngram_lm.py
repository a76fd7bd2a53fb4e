"""Stupid-backoff scores of documents from relational n-gram counts.

Exploded n-grams are dealt by hash; grouped, they give the count table, which is partitioned as
they are, so that joining them back to it needs no further exchange; the counts return to the
documents and are summed there. Three things keep this small. Each n-gram is counted within a
block of documents first, so a frequent one arrives once a block and no key is hot. What
travels is an array of n-grams for each block and hash bucket, exploded behind the exchange.
And an n-gram of three words or more is asked for only where both n-grams of one word less in
it are held, as it can't be held otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import blocks, common

#: The n-gram of no words: it is held once for each word of the corpus, and is the context of a single word.
NO_WORDS = np.uint64(0x9D39247E33776D41)
#: Bytes of text in a block, about; buckets a block, which keeps the hash tables of a bucket's counts within a processor's cache; most buckets.
BLOCK_BYTES, A_BLOCK, MOST_BITS = 4 << 20, 2, 18
CELLS = "bucket int, block int, keys array<bigint>, counts array<int>"
SCORES = "doc_id long, n_words long, n_full long, log_score double"


class _Block:
    """The n-grams of a block's documents, by the place of their last word."""

    def __init__(self, blobs, bits: int, held_out: bool):
        self.bits, self.held_out = bits, held_out
        self.ids, texts = blocks.unpack_docs(blobs)
        words = [common.word_hashes(t) for t in texts]
        self.counts = np.array([len(w) for w in words], dtype=np.int64)
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words)), self.counts)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.held: dict[int, np.ndarray] = {}  # for each n the count of the n-gram that ends at each word, in other documents if held_out
        self.all_words = 0

    def _keys(self, n: int, at: np.ndarray) -> np.ndarray:
        """The n-grams that end at these places."""
        grams = common.gram_hashes(self.words, n)
        return grams[at - (n - 1)]

    def _places(self, orders: tuple[int, ...]) -> list[np.ndarray]:
        """For each order the places whose n-gram has to be looked up."""
        out = []
        for n in orders:
            ok = self.place >= n - 1
            if n > 2:
                held = self.held[n - 1] > 0
                ok &= held & np.concatenate(([False], held[:-1]))
            out.append(np.flatnonzero(ok))
        return out

    def ask(self, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Sorted distinct keys and their counts in the block; for each order the places, and the key that each has (its number)."""
        places = self._places(orders)
        everything = [self._keys(n, at) for n, at in zip(orders, places)]
        if orders[0] == 1:
            everything.append(np.array([NO_WORDS]))
        joined = np.concatenate(everything)
        order = np.argsort(joined)
        ordered = joined[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(joined) else np.empty(0, bool)
        slot = np.empty(len(joined), dtype=np.int64)
        slot[order] = np.cumsum(new) - 1
        keys = ordered[new]
        counts = np.diff(np.append(np.flatnonzero(new), len(joined)))
        if orders[0] == 1:
            counts[slot[-1]] = len(self.words)
        return keys, counts, places, np.split(slot, np.cumsum([len(p) for p in places]))[: len(places)]

    def learn(self, orders: tuple[int, ...], replies: pa.Table, needed: int = 1) -> None:
        """Takes the corpus counts of what ask() asked for, from order `needed` on; a key without reply is held by this block alone."""
        keys, totals, places, slots = self.ask(orders)
        if len(replies):
            bucket, first, _ = _cuts(keys, self.bits)
            at, total = replies["at"].combine_chunks(), replies["total"].combine_chunks()
            start = first[np.searchsorted(bucket, replies["bucket"].to_numpy())]
            totals[np.repeat(start, pc.list_value_length(at).to_numpy()) + at.flatten().to_numpy()] = total.flatten().to_numpy()
        if orders[0] == 1:
            self.all_words = int(totals[np.searchsorted(keys, NO_WORDS)])
        for n, at, slot in zip(orders, places, slots):
            if n < needed:
                continue
            count = np.zeros(len(self.words), dtype=np.int64)
            count[at] = totals[slot] - (self._own(at, slot, len(keys)) if self.held_out else 0)
            self.held[n] = count

    def _own(self, at: np.ndarray, slot: np.ndarray, keys: int) -> np.ndarray:
        """How often the document of each place holds the key."""
        pair = self.doc[at] * keys + slot
        order = np.argsort(pair)
        ordered = pair[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(pair) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(pair)))
        own = np.empty(len(pair), dtype=np.int64)
        own[order] = np.repeat(size, size)
        return own

    def scores(self, order: int, alpha: float) -> pa.Table:
        others = np.full(len(self.doc), self.all_words) - (self.counts[self.doc] if self.held_out else 0)
        back = np.log(alpha)
        log = (order - 1) * back - np.log(others + 1.0)
        level = np.zeros(len(self.doc), dtype=np.int64)
        before = others  # the count of the n - 1 words before
        for n in range(1, order + 1):
            held = self.held[n]
            hit = held > 0
            log[hit] = np.log(held[hit] / before[hit]) + (order - n) * back
            level[hit] = n
            before = np.concatenate(([0], held[:-1]))
        size = len(self.counts)
        full, total = np.bincount(self.doc[level == order], minlength=size), np.bincount(self.doc, weights=log, minlength=size)
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_words": pa.array(self.counts), "n_full": pa.array(full.astype(np.int64)), "log_score": pa.array(total.astype(np.float64))})


def _cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, where each begins, and all their limits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.empty(0, np.int64)
    return bucket[first], first, np.append(first, len(keys)).astype(np.int32)


#: The count table is partitioned by hash bucket as the exploded n-grams are, so joining them back to it takes no exchange.
#: rand() is always below 1; with it Spark makes the dealt cells once for both uses, where it would inline what is deterministic.
REPLIES = """
WITH dealt AS (SELECT /*+ REPARTITION({parts}, bucket) */ bucket, block, keys, IF(rand() < 1, counts, NULL) AS counts FROM {cells})
SELECT /*+ SHUFFLE_HASH(held) */ gram.block, gram.bucket, collect_list(gram.at) AS at, collect_list(held.total) AS total
FROM (SELECT bucket, block, at, key FROM dealt LATERAL VIEW posexplode(keys) AS at, key) AS gram
JOIN (SELECT bucket, key, sum(counts[at]) AS total FROM dealt LATERAL VIEW posexplode(keys) AS at, key GROUP BY bucket, key HAVING count(*) > 1) AS held
  ON gram.bucket = held.bucket AND gram.key = held.key
GROUP BY gram.block, gram.bucket
"""


def replies_to(cells: DataFrame, parts: int) -> DataFrame:
    """(block, bucket, at array<int>, total array<bigint>) of CELLS rows: the places in the cell of those n-grams that other blocks hold as well, and their corpus counts."""
    return cells.sparkSession.sql(REPLIES, cells=cells, parts=parts)


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, held_out: bool = True, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words long, n_full long, log_score double, per_word double) for every row.

    log_score sums ln S over the words: S = c(w1..wn) / c(w1..wn-1) for the longest n <= order
    whose n-gram is held, times alpha for each order backed off; a word that isn't held scores
    alpha^(order - 1) / (all words + 1). Plain (held_out false), counts are those of the corpus,
    in which every n-gram of a document is held. With held_out, a variant, a document's own
    occurrences are taken off all counts, so that it is scored by the other documents. n_full
    counts the words scored at full order. Null or wordless text: 0 words, score 0, per_word
    null. Repeated rows are documents of their own. An empty table gives an empty table.
    """
    if order < 1:
        raise ValueError("order must be positive")
    layout = blocks.Layout(docs, text_col, block_bytes)
    dealt = layout.deal(docs, id_col, text_col)
    bits = layout.bucket_bits(A_BLOCK, 3, MOST_BITS)
    rounds = [tuple(range(1, min(order, 2) + 1)), *((n,) for n in range(3, order + 1))]
    replies = None

    def block_of(rows: pa.Table, got: pa.Table | None, known: int) -> _Block:
        block = _Block(rows["blob"].to_pylist(), bits, held_out)
        for k in range(known):
            # the next round looks at the last order of this one alone, the scores at all
            block.learn(rounds[k], got.filter(pc.equal(got["round"], k)), 1 if known == len(rounds) else rounds[k][-1])
        return block

    def cells(rows: pa.Table, got: pa.Table | None, k: int) -> pa.Table:
        keys, counts, _, _ = block_of(rows, got, k).ask(rounds[k])
        bucket, _, limits = _cuts(keys, bits)
        block = np.full(len(bucket), rows["block"][0].as_py() if len(rows) else 0, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(limits), pa.array(x)) for x in (keys.view(np.int64), counts.astype(np.int32))]
        return pa.table({"bucket": pa.array(bucket), "block": pa.array(block), "keys": lists[0], "counts": lists[1]})

    def first(rows: pa.Table) -> pa.Table:
        return cells(rows, None, 0)

    def later(k: int):
        def asked(rows: pa.Table, got: pa.Table) -> pa.Table:
            return cells(rows, got, k)

        return asked

    for k in range(len(rounds)):
        if replies is None:
            asked = dealt.groupBy("block").applyInArrow(first, CELLS)
        else:
            asked = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(later(k), CELLS)
        answered = common.materialize(replies_to(asked, 1 << bits).withColumn("round", F.lit(k)), "ngram-counts", {common.CO_PARTITION: "false", common.HASHED_GROUPS: str(1 << 20), common.TWO_MAPS: "false"})
        replies = answered if replies is None else replies.unionByName(answered)

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        return block_of(rows, got, len(rounds)).scores(order, alpha)

    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, SCORES)
    return scored.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op3_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    scored = score(common.documents(spark, sf_dir), order=3, alpha=0.4)
    return scored.select("doc_id", "n_words", "n_full", F.round("log_score", 4).alias("log_score"), F.round("per_word", 6).alias("per_word"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT doc_id, len(w) AS n FROM d), tot AS (SELECT sum(n) AS n FROM n),
u AS (SELECT c, count(*) AS k FROM t GROUP BY ALL), ud AS (SELECT doc_id, c, count(*) AS k FROM t GROUP BY ALL),
g AS (SELECT b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY ALL), gd AS (SELECT doc_id, b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY ALL),
h AS (SELECT a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY ALL), hd AS (SELECT doc_id, a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT t.doc_id, tot.n - n.n AS others, u.k - ud.k AS c1, u2.k - ud2.k AS b1, coalesce(g.k - gd.k, 0) AS c2, coalesce(g2.k - gd2.k, 0) AS b2, coalesce(h.k - hd.k, 0) AS c3
      FROM t CROSS JOIN tot JOIN n USING (doc_id) JOIN u ON u.c = t.c JOIN ud ON ud.doc_id = t.doc_id AND ud.c = t.c
      LEFT JOIN u u2 ON u2.c = t.b LEFT JOIN ud ud2 ON ud2.doc_id = t.doc_id AND ud2.c = t.b
      LEFT JOIN g ON g.b = t.b AND g.c = t.c LEFT JOIN gd ON gd.doc_id = t.doc_id AND gd.b = t.b AND gd.c = t.c
      LEFT JOIN g g2 ON g2.b = t.a AND g2.c = t.b LEFT JOIN gd gd2 ON gd2.doc_id = t.doc_id AND gd2.b = t.a AND gd2.c = t.b
      LEFT JOIN h ON h.a = t.a AND h.b = t.b AND h.c = t.c LEFT JOIN hd ON hd.doc_id = t.doc_id AND hd.a = t.a AND hd.b = t.b AND hd.c = t.c),
r AS (SELECT doc_id, count(*) FILTER (WHERE c3 > 0) AS n_full,
        sum(CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / b2) WHEN c2 > 0 THEN ln(0.4) + ln(c2::DOUBLE / b1) WHEN c1 > 0 THEN 2 * ln(0.4) + ln(c1::DOUBLE / others) ELSE 2 * ln(0.4) - ln(others + 1) END) AS log_score
      FROM s GROUP BY 1)
SELECT n.doc_id, n.n AS n_words, coalesce(n_full, 0) AS n_full, round(coalesce(log_score, 0), 4) AS log_score,
       round(CASE WHEN n.n > 0 THEN coalesce(log_score, 0) / n.n END, 6) AS per_word
FROM n LEFT JOIN r USING (doc_id)
"""
