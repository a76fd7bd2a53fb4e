"""The op queries themselves, over whole tables, against what their contracts say in plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__
import corpus_pipeline
from tidelog.llm import queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    found = queries.queries()[name](spark, SF).collect()
    out = {r.doc_id: r for r in found}
    assert len(out) == len(found)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op1_byte_bpe")
    assert got.keys() == texts.keys()
    for k, r in got.items():
        ids = own.encode_ordinary(texts[k].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((texts[k].text or "").encode()))


def test_op2(spark, texts):
    def fingerprint(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = words(w)
        if not w:
            return 0
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        ones = np.zeros(64, dtype=int)
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            ones += np.array([h >> b & 1 for b in range(64)])
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))

    prints = {k: fingerprint(r.text) for k, r in texts.items()}
    group = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[a] != group[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert {k: (r.fingerprint, r.component_id) for k, r in rows(spark, "op2_simhash_near_dedup").items()} == {k: (f"{p:016x}", group[k]) for k, p in prints.items()}


def test_op4(spark, texts):
    split = {k: words(r.text) for k, r in texts.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    got = rows(spark, "op4_substring_dedup")
    for k, w in split.items():
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), len(gone), sha(kept.encode()))


def test_op5(spark, texts):
    got = rows(spark, "op5_pii_surrogates")
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    seen, found = {}, 0
    for k, r in texts.items():
        old, new = mail.findall(r.text or ""), mail.findall(got[k].text or "")
        assert len(old) == len(new) == got[k].n_email
        for a, b in zip(old, new):
            found += 1
            assert a.lower() != b.lower() and seen.setdefault(a.lower(), b.lower()) == b.lower()
        if not any(got[k][f"n_{t}"] for t in ("email", "ip", "card", "phone", "ssn", "name")):
            assert got[k].text == r.text
    assert found and len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())


def test_op7(spark, texts):
    got = rows(spark, "op7_secret_scan")
    for k, r in texts.items():
        t = r.text or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        named = ",".join(f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in sorted(base))
        kinds = [kind for _, kind, _ in base]
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex, got[k].base_sha256) == (kinds.count(0), kinds.count(1), kinds.count(2), sha(named.encode()))
        assert set(named.split(",")) - {""} <= set(got[k].spans.split(","))


def test_op8(spark, texts):
    got = rows(spark, "op8_quality_rules")
    for k, r in texts.items():
        t = r.text or ""
        w = words(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = len({p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)})
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        assert tuple(got[k])[1:7] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, failed)
        assert not (failed and got[k].kept)


def test_op9(spark, texts):
    got = rows(spark, "op9_mix_sources")
    names = sorted({r.source for r in texts.values()}, key=lambda s: (s is None, s))
    size = {s: sum(len(words(r.text)) for r in texts.values() if r.source == s) for s in names}
    for s in names:
        mine = [r for k, r in got.items() if texts[k].source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and mine[0].target <= 3 * size[s] + 1e-6
        assert all(r.taken <= 3 * r.size and r.source_size == size[s] for r in mine)
    assert abs(sum({texts[k].source: r.target for k, r in got.items()}.values()) - sum(size.values())) < 1e-3 or any(abs(r.target - 3 * r.source_size) < 1e-6 for r in got.values())
    assert all(r.size == len(words(texts[k].text)) for k, r in got.items())
    assert {k: tuple(r) for k, r in rows(spark, "op9_mix_sources").items()} == {k: tuple(r) for k, r in got.items()}


def test_op10(spark, texts):
    got = rows(spark, "op10_avi_media")
    for k, r in texts.items():
        raw = (r.text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:]))
        assert got[k].media_bytes > got[k].payload_bytes and re.match(r"frames=\d+;shots=\d+;0-\d+", got[k].feature)


def test_op3_and_op6_cover_all_rows(spark, texts):
    scored, shards = rows(spark, "op3_stupid_backoff"), rows(spark, "op6_extendible_shards")
    assert scored.keys() == shards.keys() == texts.keys()
    assert all(scored[k].n_words == len(words(r.text)) and shards[k].bytes == len((r.text or "").encode()) for k, r in texts.items())


def test_pipeline_against_plain_python(spark, texts):
    """Each stage on what the one before kept."""
    docs = [r.asDict() for r in texts.values()]
    judged = rows(spark, "op8_quality_rules")
    kept = [r for r in docs if judged[r["doc_id"]].kept]
    shingles = {}
    for r in kept:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
        w = words(w)
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(shingles)
    group = {k: k for k in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    for _ in ids:
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    kept = [r for r in kept if group[r["doc_id"]] == r["doc_id"]]
    current = spark.read.parquet(f"{SF}/documents.parquet")
    columns = current.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        current = stage(spark, current, SF)
        current = spark.createDataFrame(current.collect(), current.schema)
        found = current.collect()
        if k == 1:
            assert sorted(r.doc_id for r in found) == [r["doc_id"] for r in sorted(kept, key=lambda r: r["doc_id"])]
        if k == 2:
            assert len(found) == len(kept) and not any(re.search(r"AKIA[A-Z0-9]{16}", r.text) for r in found)
        if k < 4:
            assert current.columns == columns
    assert all(len(r.token_ids) == r.n_tokens and r.decoded_sha256 == sha(r.text.encode()) for r in found)
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.ids_sha256) for r in whole.collect()) == Counter((r.doc_id, r.ids_sha256) for r in found)


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert all(sum(name.startswith(f"op{n}_") for name in known) == 1 for n in range(1, 11)) and "pipeline" in known
    assert set(__spark_entry__.oracle_sql()) <= set(known)
