"""Repeated word windows, found through a log-structured index of window fingerprints.

The index holds the hashes of all windows that it was given: sorted immutable runs, one Parquet
row a key range. A new batch becomes a run, is merge-joined with the runs there are, and runs of
one size are compacted. What the merge-join reports is verified: within one call by 128 bits of
two independent hashes over all words of a window, taken from the texts again; against the
batches of earlier calls by the 96 bits that the runs keep of each window.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import blocks, common

CELLS = "bucket int, block int, keys binary, extra binary"
RUN = "bucket int, keys binary, extra binary"
#: Bits of a hash in an index that lasts one call; they only tell candidates, which are verified.
SHORT = 46


def _again(keys: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys (with their checks), where a new one begins in it, and how many there are of each."""
    order = np.argsort(keys) if check is None else np.lexsort((check, keys))
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    if check is not None:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(k)))


def _in(keys: np.ndarray, check: np.ndarray | None, run: np.ndarray, run_check: np.ndarray | None) -> np.ndarray:
    """Which of the sorted keys (with their checks) a run holds: two sorted lists merged."""
    found = np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(run, keys)
    left = np.arange(len(keys))
    while len(left):  # equal keys with other checks stand side by side; there is rarely a second one
        left = left[at[left] < len(run)]
        left = left[run[at[left]] == keys[left]]
        found[left] = True if check is None else run_check[at[left]] == check[left]
        left = left[~found[left]]
        at[left] += 1
    return found


class _Format:
    """What the extra of a row holds: a bit a key, whether it is there more than once, and in a lasting index its check."""

    def __init__(self, lasting: bool):
        self.lasting = lasting

    def write(self, many: np.ndarray, check: np.ndarray | None) -> bytes:
        return np.packbits(many).tobytes() + (check.astype("<u4").tobytes() if self.lasting else b"")

    def read(self, extra: bytes, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        bits = -(-n // 8)
        many = np.unpackbits(np.frombuffer(extra, np.uint8, bits), count=n).astype(bool)
        return many, np.frombuffer(extra, "<u4", n, bits) if self.lasting else None

    def merged(self, rows: pd.DataFrame) -> pd.DataFrame:
        """One row of a bucket's sorted distinct keys."""
        keys = [blocks.unpack(b) for b in rows["keys"]]
        parts = [self.read(e, len(k)) for e, k in zip(rows["extra"], keys)]
        everything = np.concatenate(keys)
        check = np.concatenate([c for _, c in parts]) if self.lasting else None
        order, first, n = _again(everything, check)
        many = np.concatenate([m for m, _ in parts])[order]
        many = np.logical_or.reduceat(many, first) | (n > 1) if len(first) else many
        extra = self.write(many, None if check is None else check[order][first])
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy(), "keys": [blocks.pack(everything[order][first])], "extra": [extra]})

    def met(self, fresh: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        """The keys of fresh rows that are there again, with a byte each (1: in the batch, 2: earlier), and their checks."""
        runs = [(blocks.unpack(k), e) for k, e in zip(old["keys"], old["extra"])]
        found = []
        for bucket, blob, extra in zip(fresh["bucket"], fresh["keys"], fresh["extra"]):
            keys = blocks.unpack(blob)
            many, check = self.read(extra, len(keys))
            level = many.astype(np.uint8)
            for run, e in runs:
                level[_in(keys, check, run, self.read(e, len(run))[1])] = 2
            hit = level > 0
            if hit.any():
                found.append((int(bucket), blocks.pack(keys[hit]), level[hit].tobytes() + (check[hit].tobytes() if self.lasting else b"")))
        return pd.DataFrame(found, columns=["bucket", "keys", "extra"])


class WindowIndex:
    """Sorted runs of window hashes under one folder, which may hold runs already: opening it again goes on.

    A run is a folder whose name tells how many batches are in it; one without _SUCCESS was cut
    short and isn't read. A row is a key range: its sorted hashes and, in an index that lasts
    (bits 64), 32 bits of a second hash for each. Runs never change; compaction writes a new
    one and drops the old, and when it is cut short in between the keys are there twice, which
    changes nothing. One call at a time may append.
    """

    def __init__(self, spark: SparkSession, folder: str, bits: int = 64, fanout: int = 4, bucket_bits: int = 10):
        self.spark, self.folder, self.bits, self.fanout, self.bucket_bits = spark, folder.rstrip("/"), bits, fanout, bucket_bits
        self.format = _Format(bits == 64)

    @property
    def lasting(self) -> bool:
        return self.format.lasting

    def runs(self) -> list[tuple[str, int]]:
        """(path, batches) of the complete runs."""
        out = []
        for name in common.list_names(self.spark, self.folder):
            if name.startswith("run-") and "_SUCCESS" in common.list_names(self.spark, f"{self.folder}/{name}"):
                out.append((f"{self.folder}/{name}", int(name.split("-")[1])))
        return sorted(out)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def _write(self, rows: DataFrame, batches: int) -> str:
        path = f"{self.folder}/run-{batches}-{uuid.uuid4().hex}"
        form = self.format
        with common.settings(self.spark, {common.CLEANUP: "true"}):
            rows.groupBy("bucket").applyInPandas(lambda rows: form.merged(rows), RUN).write.parquet(path)
        return path

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of CELLS rows; returns (bucket, keys, extra) of those that are there again.

        extra is a byte a key: 1 if the batch itself holds it more than once, 2 if an earlier
        batch does; in a lasting index the checks of the keys follow.
        """
        history = [path for path, _ in self.runs()]
        new = self._read([self._write(batch.select("bucket", "keys", "extra"), 1)])
        form = self.format
        if history:
            rows = new.groupBy("bucket").cogroup(self._read(history).groupBy("bucket")).applyInPandas(lambda fresh, old: form.met(fresh, old), RUN)
        else:
            rows = new.mapInPandas(lambda parts: (form.met(part, part.iloc[:0]) for part in parts), RUN)
        hits = common.materialize(rows, "window-hits")
        self.compact()
        return hits

    def compact(self) -> None:
        """Merges runs of one size, `fanout` at a time, so that a key is rewritten once a level."""
        while True:
            runs = self.runs()
            sizes = [size for _, size in runs]
            full = next((s for s in sorted(set(sizes)) if sizes.count(s) >= self.fanout), None)
            if full is None:
                return
            old = [path for path, size in runs if size == full]
            self._write(self._read(old), full * len(old))
            for path in old:
                common.delete_path(self.spark, path)

    def drop(self) -> None:
        common.delete_path(self.spark, self.folder)


# ---- windows of a block ----------------------------------------------------------------------


class _Windows:
    """The windows of a block's texts: document and start of each, and its hash; the distinct hashes in order."""

    def __init__(self, blobs, window: int):
        self.ids, self.texts = blocks.unpack_docs(blobs)
        self.window = window
        hashes = [common.gram_hashes(common.word_hashes(t), window) for t in self.texts]
        size = np.array([len(h) for h in hashes], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(hashes)), size)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(size) - size, size)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.order, self.first, self.n = _again(self.hash, None)
        self.keys = self.hash[self.order][self.first]

    def slots(self) -> np.ndarray:
        """For each window the number of its hash."""
        out = np.empty(len(self.hash), dtype=np.int64)
        out[self.order] = np.repeat(np.arange(len(self.first)), self.n)
        return out

    def checks(self, at: np.ndarray) -> np.ndarray:
        """A second, independent hash of these windows."""
        out = np.empty(len(at), dtype=np.uint64)
        cuts = np.searchsorted(self.doc[at], np.arange(len(self.texts) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = at[cuts[k] : cuts[k + 1]]
            out[cuts[k] : cuts[k + 1]] = common.gram_hashes(common.word_hashes(self.texts[k], 1), self.window)[self.start[mine]]
        return out

    def first_checks(self) -> np.ndarray:
        """The upper half of the second hash of each distinct window."""
        at = np.sort(self.order[self.first])
        check = np.empty(len(self.hash), dtype=np.uint64)
        check[at] = self.checks(at)
        return (check[self.order[self.first]] >> np.uint64(32)).astype(np.uint32)


_PLACED = np.dtype([("check", "<u8"), ("n", "u1")])


def _verified(rows: pd.DataFrame) -> pd.DataFrame:
    """For each cell of a bucket a byte a window: 1 if both its hashes are at two places or more."""
    keys = np.concatenate([blocks.unpack(b) for b in rows["keys"]])
    extra = np.concatenate([np.frombuffer(e, _PLACED) for e in rows["extra"]])
    order, first, n = _again(keys, extra["check"])
    flag = np.empty(len(keys), dtype=np.uint8)
    flag[order] = np.repeat(np.add.reduceat(extra["n"][order].astype(np.int64), first) > 1, n) if len(first) else 0
    ends = np.cumsum([len(e) // _PLACED.itemsize for e in rows["extra"]])[:-1]
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "reply": [part.tobytes() for part in np.split(flag, ends)]})


REPLIES = "block int, bucket int, reply binary"


def _joined(replies: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.uint8) for b in replies.sort_values("bucket")["reply"]] or [np.empty(0, np.uint8)])


def remove_repeats(docs: DataFrame, window: int = 35, batches: int = 2, index: WindowIndex | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words long, n_removed long, kept string) for every row.

    Removes each word covered by a window of `window` words whose sequence also starts at
    another place of docs, in the same text or another; windows are judged on the input. kept is
    the remaining words joined by one space. With an index (WindowIndex with bits 64), docs are
    one more delivery: windows that earlier deliveries held go as well, and the index learns
    those of docs. Without one, an index of this call alone is fed in `batches` batches. Null
    text has no words; texts shorter than a window keep all; repeated rows are places of their
    own and lose everything a window covers. An empty table gives an empty table.
    """
    if window < 1:
        raise ValueError("a window takes a word at least")
    if index is not None and not index.lasting:
        raise ValueError("an index that lasts keeps 64 bits")
    spark = docs.sparkSession
    layout = blocks.Layout(docs, text_col, block_bytes)
    dealt = layout.deal(docs, id_col, text_col)
    own = index is None
    if own:
        index = WindowIndex(spark, f"{common.scratch_dir(spark)}/window-index-{uuid.uuid4().hex}", SHORT, bucket_bits=layout.bucket_bits(0.25, 7))
    key_bits, top, lasting, form = index.bits, index.bucket_bits, index.lasting, index.format
    cut_off = np.uint64(64 - key_bits)

    def cells(rows: pd.DataFrame) -> pd.DataFrame:
        w = _Windows(rows["blob"], window)
        keys, check = w.keys >> cut_off, w.first_checks() if lasting else None
        out = []
        for bucket, a, b in blocks.cuts(keys, top, key_bits):
            out.append((bucket, int(rows["block"].iloc[0]), blocks.pack(keys[a:b]), form.write(w.n[a:b] > 1, check[a:b] if lasting else None)))
        return pd.DataFrame(out, columns=["bucket", "block", "keys", "extra"])

    asked = common.materialize(dealt.groupBy("block").applyInPandas(cells, CELLS), "windows")
    parts = [asked.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == k) for k in range(batches)] if own else [asked]
    hits = [index.append(part) for part in parts]
    if own:
        index.drop()
    repeated = hits[0]
    for more in hits[1:]:
        repeated = repeated.unionByName(more)

    def met(cell: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        keys = [blocks.unpack(b) for b in known["keys"]]
        level = [np.frombuffer(e, np.uint8, len(k)) for e, k in zip(known["extra"], keys)]
        check = [np.frombuffer(e, "<u4", len(k), len(k)) for e, k in zip(known["extra"], keys)] if lasting else None
        everything = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(everything) if not lasting or not keys else np.lexsort((np.concatenate(check), everything))
        everything, levels = everything[order], np.concatenate(level)[order] if keys else np.empty(0, np.uint8)
        checks = np.concatenate(check)[order] if lasting and keys else None
        out = []
        for blob, extra in zip(cell["keys"], cell["extra"]):
            mine = blocks.unpack(blob)
            if not lasting:
                out.append(_in(mine, None, everything, None).astype(np.uint8).tobytes())
                continue
            own_check = form.read(extra, len(mine))[1]
            reply = np.zeros(len(mine), dtype=np.uint8)
            for n in (1, 2):
                some = levels == n
                if some.any():
                    reply[_in(mine, own_check, everything[some], checks[some])] = n
            out.append(reply.tobytes())
        return pd.DataFrame({"block": cell["block"], "bucket": cell["bucket"], "reply": out})

    replies = common.materialize(asked.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInPandas(met, REPLIES), "windows-met")
    common.discard(asked, *hits)

    def candidates(rows: pd.DataFrame, got: pd.DataFrame):
        """The windows, which are met again (1: here, 2: earlier), the places to verify in order, and both their hashes."""
        w = _Windows(rows["blob"], window)
        level = _joined(got)
        level = level[w.slots()] if len(w.hash) else np.empty(0, np.uint8)
        at = np.flatnonzero(level == 1)
        check = w.checks(at)
        order, first, n = _again(w.hash[at], check)
        return w, level, at, check, order, first, n

    def verify(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "keys", "extra"]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        w, _, at, check, order, first, n = candidates(rows, got)
        keys = w.hash[at][order][first]
        extra = np.empty(len(keys), dtype=_PLACED)
        extra["check"], extra["n"] = check[order][first], np.minimum(n, 2)
        return pd.DataFrame([(bucket, int(rows["block"].iloc[0]), blocks.pack(keys[a:b]), extra[a:b].tobytes()) for bucket, a, b in blocks.cuts(keys, top)], columns=columns)

    found = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(verify, CELLS)
    verdicts = found.groupBy("bucket").applyInPandas(_verified, REPLIES)
    both = replies.withColumn("step", F.lit(0)).unionByName(verdicts.withColumn("step", F.lit(1)))

    def cut(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        w, level, at, _, order, first, n = candidates(rows, got[got["step"] == 0])
        sure = np.zeros(len(at), dtype=bool)
        sure[order] = np.repeat(_joined(got[got["step"] == 1]) > 0, n)
        gone = level == 2
        gone[at[sure]] = True
        doc, start = w.doc[gone], w.start[gone]
        edges = np.searchsorted(doc, np.arange(len(w.texts) + 1))
        out = []
        for k, (doc_id, text) in enumerate(zip(w.ids, w.texts)):
            words = text.split()
            own_starts = start[edges[k] : edges[k + 1]]
            kept = words
            if len(own_starts):
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                cover[own_starts] += 1
                np.add.at(cover, own_starts + window, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": object})

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.documents(spark, sf_dir), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY 1),
k AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN c USING (doc_id)),
o AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
f AS (SELECT o.doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM o ANTI JOIN (SELECT DISTINCT doc_id, unnest(ps) AS p FROM c) z ON z.doc_id = o.doc_id AND z.p = o.p GROUP BY 1)
SELECT k.doc_id, len(w) AS n_words, len(ps) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN f USING (doc_id)
"""
