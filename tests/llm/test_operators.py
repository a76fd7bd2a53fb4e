import base64
import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import avi, blocks, bpe, common, graph, jaccard, mixing, ngram_lm, pii, quality, secret_scan, sharding, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, hash string, taken string"
VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")


def corpus():
    rng = random.Random(3)
    words = ["w%d" % k for k in range(60)] + ["Ünï", "日本", "a.b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 160))) for _ in range(40)]
    shared = " ".join(rng.choice(words) for _ in range(50))
    texts += [f"x{k} {shared} y{k}\n {rng.random()}" for k in range(4)]
    texts += [texts[0], texts[0], texts[1] + " tail", "", None, " \t\n", "one", "lorem ipsum " * 40, "z" * 20_000, " ".join(words * 300)]
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, 0, 7, "h", "t") for k, t in enumerate(texts)]
    return rows + [(5, texts[5], "en", "s1", 0, 7, "h", "t"), (None, "null id here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


# ---- 1 ----


def test_bpe_equals_tiktoken(docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs, VOCAB, public_tokenizers.PATTERN, keep=["doc_id", "text"])
    for r in out.collect():
        assert r.token_ids == own.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{r.n_tokens}I", *r.token_ids)).hexdigest()
    back = bpe.decode(out.select("doc_id", "token_ids", out.text.alias("was")), VOCAB)
    assert all(r.text == (r.was or "") for r in back.collect())
    assert bpe.encode(nothing, VOCAB, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", r"\S+|\s+"])
def test_bpe_with_other_patterns(spark, pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [("a cat, sat", 1), ("  two  spaces 12 ", 2), ("", 3), (None, 4), ("日本 語", 5)]
    docs = spark.createDataFrame(rows, "text string, text_to_encode long")
    for r in bpe.encode(docs, VOCAB, pattern).collect():
        assert r.token_ids == own.encode_ordinary(r.text or "") and r.text_to_encode in range(1, 6)


def test_bpe_odd_texts():
    codec = bpe.Codec(bpe.load_ranks(VOCAB), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    pool = [" ", " ", "\n", "'s", " ", "　", "a", "Z", "9", ",", "é", "\U0001f600", "▁", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


# ---- 2 ----


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, nothing):
    rows = [(r[0], brute_print(r[1])) for r in corpus()]
    group = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 4:
                    group[i] = min(group[i], group[j])
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    want = [(d, fp - (fp >> 63 << 64), least.get(g)) for (d, fp), g in zip(rows, group)]
    assert ordered(simhash.near_duplicates(docs).collect()) == ordered(want)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize(("budget", "agree", "chunk"), [(4, 1, 4096), (4, 1, 16), (4, 1, 2), (4, 3, 4096), (6, 2, 4096), (6, 2, 3), (0, 1, 4), (9, 1, 8)])
def test_trie_walk_finds_all_links(spark, budget, agree, chunk):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = {0} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in centres for _ in range(12)}
    prints = sorted(p - (p >> 63 << 64) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(df, budget, agree, chunk)).collect()}
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= budget:
                parent[find(a)] = find(b)
    same = lambda f: sorted(sorted(x) for x in _groups(prints, f))
    assert same(lambda p: roots.get(p, p)) == same(find)


def test_more_fingerprints_make_longer_prefixes_not_more_copies():
    assert [simhash.agreeing(n, 4) for n in (0, 10**6, 10**7, 10**8, 10**9, 10**10, 10**12)] == [1, 1, 1, 2, 2, 3, 4]
    assert len(simhash._tables(4, 3)) == 35


def _groups(items, key):
    out = {}
    for x in items:
        out.setdefault(key(x), []).append(x)
    return out.values()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert len({roots[k] for k in range(201)}) == 1 and roots[500] == roots[501] != roots[0]


def test_one_of_each_group_stays(docs, nothing):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert 0 in kept and 44 not in kept and 45 not in kept and kept.count(5) == 1 and None in kept
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(nothing).count() == 0


def test_equal_ids_and_wordless_rows(spark):
    one, other = "first text of five words or more here", "quite another text that shares nothing with it"
    rows = [(3, one), (5, one), (5, other), (8, None), (8, None), (9, ""), (9, ""), (11, other), (11, other), (None, one), (None, one), (12, "third text alone but twice there"), (12, "third text alone but twice there")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, gone int")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(3, one), (5, other), (8, None), (8, None), (9, ""), (9, ""), (None, one), (None, one), (12, rows[-1][1])], key=repr)
    near = [(5, "a b c d e f g h i j k l m n o p q r s t u v w x y"), (5, "a b c d e f g h i j k l m n o p q r s t u v w x z")]
    assert simhash.keep_one(spark.createDataFrame(near, "doc_id long, text string")).count() == 1


def near_copies(seed=4):
    """Texts around similarity 0.8, on both sides, an exact copy of each kind, short texts and a line that all hold."""
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    line, texts = "the line that all of these texts do hold in common".split(), []
    for _ in range(40):
        base = fresh(rng.randrange(40, 300)) + line
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for at in rng.sample(range(len(other)), rng.randrange(1, max(2, len(other) // 25))):
                other[at] = f"n{rng.randrange(5000)}"
            texts.append(other)
    texts += [texts[0], ["only", "three", "words"], ["only", "three", "words"], ["Only", "three", "WORDS"], ["other"]]
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


def similar_groups(texts):
    sets = {}
    for k, t in texts:
        w = t.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            return group


@pytest.mark.parametrize(("chunk", "batch", "block", "bits"), [(1 << 24, 1 << 24, 1 << 24, 46), (4000, 1, 9000, 46), (1 << 24, 1 << 24, 9000, 12)])
def test_near_copies_are_those_of_jaccard(spark, monkeypatch, chunk, batch, block, bits):
    for module, name, value in ((jaccard, "CHUNK_BYTES", chunk), (jaccard, "BATCH_BYTES", batch), (blocks, "BLOCK_BYTES", block), (jaccard, "KEY_BITS", bits)):
        monkeypatch.setattr(module, name, value)
    texts = near_copies()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    group = similar_groups(texts)
    assert {r.doc_id: r.component_id for r in jaccard.components(docs).collect()} == group
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(k for k in group if group[k] == k)


def test_near_copies_within_the_budget_come_from_the_trie_alone(spark, monkeypatch):
    texts = near_copies()
    texts += [(1000 + k, t + " end") for k, t in texts if len(t.split()) > 100]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {k: jaccard.shingles(t.encode(), 5) for k, t in texts}
    prints = {k: jaccard.fingerprint(x) for k, x in sets.items()}
    same = {(a, b): 5 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (len(sets[a]) + len(sets[b]) - both) for a in sets for b in sets if a < b}
    far = {k: k for k in sets}
    while True:  # classes without the links of one to four bits
        before = dict(far)
        for (a, b), linked in same.items():
            if linked and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() not in range(1, 5):
                far[a] = far[b] = min(far[a], far[b])
        if far == before:
            break
    kept = lambda: sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    whole = similar_groups(texts)
    assert kept() == sorted(k for k in whole if whole[k] == k)
    monkeypatch.setattr(simhash, "links", lambda prints, *_: prints.selectExpr("fp AS a", "fp AS b").where("false"))
    assert (without := kept()) != sorted(k for k in whole if whole[k] == k)
    assert without == sorted(k for k in far if far[k] == k)


# ---- 3 ----


@pytest.mark.parametrize(("order", "held_out"), [(1, True), (2, True), (3, True), (4, True), (1, False), (3, False)])
def test_stupid_backoff(docs, nothing, order, held_out):
    texts = [split(r[1]) for r in corpus()]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in texts), Counter()) for n in range(1, order + 1)]
    words = sum(map(len, texts))
    want = []
    for row, w in zip(corpus(), texts):
        own, score, full = [grams(w, n) if held_out else Counter() for n in range(1, order + 1)], 0.0, 0
        others = words - len(w) * held_out
        held = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        for i in range(len(w)):
            s, n = None, min(order, i + 1)
            while n:
                g = tuple(w[i - n + 1 : i + 1])
                if held(g) > 0:
                    s = held(g) / (held(g[:-1]) if n > 1 else others) * 0.4 ** (order - n)
                    full += n == order
                    break
                n -= 1
            score += math.log(s if s else 0.4 ** (order - 1) / (others + 1))
        want.append((row[0], len(w), full, round(score, 6)))
    got = ngram_lm.score(docs, order, held_out=held_out, block_bytes=4000).collect()
    assert ordered((r.doc_id, r.n_words, r.n_full, round(r.log_score, 6)) for r in got) == ordered(want)
    assert all((r.per_word is None) == (r.n_words == 0) for r in got)
    assert ngram_lm.score(nothing, order).count() == 0


def test_count_table_joins_without_another_exchange(spark):
    rows = spark.createDataFrame([(1, 1, [4, 5, 7], [1, 1, 2]), (1, 2, [5], [3]), (2, 2, [9], [1])], ngram_lm.CELLS)
    cells = rows.groupBy("block").applyInPandas(lambda x: x, ngram_lm.CELLS)
    with common.settings(spark, {common.CO_PARTITION: "false"}):
        replies = ngram_lm.replies_to(cells, 3)
        assert ordered(replies.collect()) == [(1, 1, [1], [4]), (2, 1, [0], [4])]
        plan = replies._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ShuffledHashJoin" in plan and plan.count("FlatMapGroupsInPandas") == 1 and "ReusedExchange" in plan
    assert plan.count("+- Exchange ") == 2


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 999, dtype=np.uint64))
    for k in (keys, keys[:1], keys[:0], np.array([3, 3, 9], dtype=np.uint64)):
        assert (blocks.unpack(blocks.pack(k)) == k).all()


def test_word_hashes_cut_into_pieces(monkeypatch):
    data = " ".join(f"word{k % 50}" + "x" * (k % 25) for k in range(3000)).encode()
    whole = common.word_hashes(data)
    monkeypatch.setattr(common, "PIECE", 100)
    assert (common.word_hashes(data) == whole).all() and len(set(whole.tolist())) == len(set(data.split()))
    assert not set(common.word_hashes(data, 1).tolist()) & set(whole.tolist())
    runs = {n: common.gram_hashes(whole, n) for n in (1, 2, 3, 5, 8, 35)}
    words = data.split()
    for n, h in runs.items():
        assert len(h) == len(words) - n + 1 and len(set(h.tolist())) == len({tuple(words[i : i + n]) for i in range(len(h))})


def thue_morse(n, a="a", b="b"):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


@pytest.mark.parametrize("size", [1024, 2048])
def test_patterned_words_do_not_collide(spark, size):
    """Words for which any polynomial hash modulo 2^64 gives one value."""
    one, two = thue_morse(size), thue_morse(size, "b", "a")
    texts = [(k, " ".join([w if i == 17 else f"c{i}" for i in range(35)])) for k, w in enumerate((one, two))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    a, b = common.word_hashes(f"{one} {two}".encode()).tolist()
    assert a != b
    scored = {r.doc_id: r for r in ngram_lm.score(spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string"), 1).collect()}
    assert scored[1].n_full == scored[3].n_full == 1 and scored[2].n_full == 0


# ---- 4 ----


@pytest.mark.parametrize(("window", "batches"), [(35, 3), (10, 1), (8, 5), (1, 2)])
def test_repeated_windows(docs, nothing, window, batches):
    texts = [split(r[1]) for r in corpus()]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    want = []
    for row, w in zip(corpus(), texts):
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        want.append((row[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring_dedup.remove_repeats(docs, window, batches, block_bytes=4000)
    assert ordered(got.collect()) == ordered(want)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_index_outlives_calls_and_compacts(spark, tmp_path):
    """Deliveries one after the other, the index opened anew each time: windows of earlier ones go, earlier results don't change."""
    rng = random.Random(8)
    fresh = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    shared, window, seen = fresh(60), 35, Counter()
    for k in range(5):
        batch = [fresh(50) + shared[: 34 + k] + fresh(20), fresh(80), shared if k == 3 else fresh(40)]
        index = substring_dedup.WindowIndex(spark, f"file://{tmp_path}/index", fanout=2)
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(batch)], "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, window, index=index, block_bytes=500).collect()}
        now = Counter(tuple(w[i : i + window]) for w in batch for i in range(len(w) - window + 1))
        for i, w in enumerate(batch):
            starts = [j for j in range(len(w) - window + 1) if now[tuple(w[j : j + window])] > 1 or seen[tuple(w[j : j + window])]]
            assert got[i] == len({p for j in starts for p in range(j, j + window)})
        seen += now
        assert sorted(n for _, n in index.runs()) == {0: [1], 1: [2], 2: [1, 2], 3: [4], 4: [1, 4]}[k]
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, window, index=substring_dedup.WindowIndex(spark, f"file://{tmp_path}/other", 46))


def test_equal_keys_are_told_apart_by_their_checks():
    keys, check = np.array([3, 3, 3, 9], dtype=np.uint64), np.array([1, 2, 5, 1], dtype=np.uint32)
    run, run_check = np.array([3, 3, 9], dtype=np.uint64), np.array([2, 5, 2], dtype=np.uint32)
    assert substring_dedup._in(keys, check, run, run_check).tolist() == [False, True, True, False]
    assert substring_dedup._in(keys, None, run[:0], None).tolist() == [False] * 4


# ---- 5 ----


def test_surrogates(spark, nothing):
    text = "Call +1 (456) 555-2186 or +1 456-555-2186. Mr Smith met Mrs. SMITH and г-жа Иванова; 42.144.35.254, 4041894974608795, ab.42@Mail8.example.com"
    rows = [(1, text, "keep"), (2, None, None), (3, "", "x"), (4, "ab.42@mail8.example.com 042", "x"), (4, "ab.42@mail8.example.com 042", "x"), (5, "v1.2.3 costs 12 345", "x")]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, entities string"), "key").collect()
    new = {r.doc_id: r for r in out}
    assert len(out) == 6 and new[2].text is None and new[3].text == "" and new[5].text == rows[5][1]
    t = new[1].text
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))
    phones = re.findall(r"\+1 \(?\d{3}\)?[ -]\d{3}-\d{4}", t)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1 and "555-2186" not in t
    card = re.search(r"\d{16}", t)[0]
    assert card[0] == "4" and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(card[::-1])) % 10 == 0
    # one surname, borne by a man and a woman, is one entity; a name that only women bear gets a woman's ending
    m = re.search(r"Mr ([A-Z][a-z]+) met Mrs\. ([A-Z]+) and г-жа [А-Я][а-я]+(а|ия);", t)
    assert m[1].upper() == m[2] and "Smith" not in t and "Иванова" not in t
    mail = re.search(r"\S+@\S+", t)[0]
    assert shape(mail) == shape("ab.42@Mail8.example.com") and mail.lower() == new[4].text.split()[0] and new[4].text.endswith(" 042")
    assert new[1].entities == {"email": 1, "ip": 1, "card": 1, "phone": 2, "ssn": 0, "name": 3}
    assert pii.pseudonymize(nothing, "key").count() == 0


def pseudonyms(spark, *texts):
    rows = pii.pseudonymize(spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, a string"), "key").orderBy("doc_id").collect()
    assert {r.a for r in rows} <= {"mine"}
    return [r.text for r in rows]


def test_people_are_replaced_throughout(spark):
    first, second, third, none = pseudonyms(
        spark,
        "Mr. John Smith met Mr Smith's sister. Smith left, SMITH came; John too. Prof. Dr. Karl von Stein and Herr Stein, Mrs J. Doe-Roe.",
        "Ms Smith wrote. Ghosts of Smithfield and of a smith remain.",
        "г-жа Анна Иванова и Иванова; κυρία Μαρία",
        "Smith is not known here. Mr. and Mrs. were.",
    )
    for word in ("John", "Smith", "SMITH", "Karl", "Stein", "Doe", "Roe", "Анна", "Иванова", "Μαρία"):
        assert not re.search(rf"\b{word}\b", first + third)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mr (\w+)'s sister\. (\w+) left, (\w+) came; (\w+) too\. Prof\. Dr\. (\w+) von (\w+) and Herr (\w+), Mrs J\. (\w+)\.", first)
    john, smith = m[1], m[2]
    assert m[3] == m[4] == smith and m[5] == smith.upper() and m[6] == john and m[8] == m[9] and len({john, smith, m[7], m[8], m[10]}) == 5
    assert second == f"Ms {smith} wrote. Ghosts of Smithfield and of a smith remain."
    x = re.fullmatch(r"г-жа ([А-Я][а-я]+) ([А-Я][а-я]+) и (\w+); κυρία ([Α-Ω][α-ω]+)", third)
    assert x[2] == x[3] and x[1] != x[2]
    assert none == "Smith is not known here. Mr. and Mrs. were."


def test_numbers_and_addresses(spark):
    texts = [
        "Call +49 30 1234567 or +49-30-1234567, not +44 20 7946 0958; 2001:db8::1, 2001:0DB8:0:0:0:0:0:1 and fe80::2; 10.1.2.3 8.8.8.8 at 12:30:45 in std::vector a::b",
        "4111 1111 1111 1111 is a card, 4111 1111 1111 1112 isn't, 378282246310005 is; (456) 555-2186 is +1 456-555-2186",
    ]
    one, two = pseudonyms(spark, *texts)
    m = re.fullmatch(r"Call (\+49 \d\d \d{7}) or (\+49-\d\d-\d{7}), not (\+44 \d\d \d{4} \d{4}); (\S+), (\S+) and (\S+); (10\.\d+\.\d+\.\d+) (\d+\.\d+\.\d+\.\d+) at 12:30:45 in std::vector a::b", one)
    flat = lambda t: re.sub(r"\D", "", t)
    assert flat(m[1]) == flat(m[2]) != "49301234567" and flat(m[3]) != "442079460958"
    assert m[4] == m[5] != m[6] and m[4].startswith("2001:0db8:") and m[7] != "10.1.2.3" and m[8] != "8.8.8.8" and 30 <= int(m[8].split(".")[0]) < 120
    m = re.fullmatch(r"(4\d{3} \d{4} \d{4} \d{4}) is a card, 4111 1111 1111 1112 isn't, (3\d{14}) is; (\(\d{3}\) \d{3}-\d{4}) is (\+1 \d{3}-\d{3}-\d{4})", two)
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    assert luhn(flat(m[1])) and luhn(m[2]) and "1" + flat(m[3]) == flat(m[4]) and flat(m[3]) != "4565552186" and m[1] != "4111 1111 1111 1111"


def test_distinctness_and_coreference_over_a_corpus(spark):
    """Every entity, however often and wherever, against a dictionary kept by hand; hot copies of one text included."""
    rng = random.Random(6)
    mails = [f"user{k}@mail{k % 3}.example.com" for k in range(60)]
    people = [f"{a}{b}" for a in ("Ander", "Brun", "Cald", "Dres", "Erl") for b in ("son", "er", "well", "ik")]
    ips = [f"8.{k}.1.2" for k in range(40)]
    texts = []
    for _ in range(120):
        words = [rng.choice((rng.choice(mails), f"Mr {rng.choice(people)}", rng.choice(ips), "plain", "text")) for _ in range(12)]
        texts.append(" ".join(words))
    texts += [texts[0]] * 1500
    new = pseudonyms(spark, *texts)
    seen, counts = {}, 0
    for before, after in zip(texts, new):
        for x, y in zip(before.split(" "), after.split(" "), strict=True):
            if x in ("Mr", "plain", "text"):
                assert x == y
                continue
            assert seen.setdefault(x, y) == y and x != y
            counts += 1
    assert counts > 5000 and len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())


@pytest.mark.parametrize("narrow", [pii.NARROW, 0])
def test_surrogates_stay_distinct(spark, monkeypatch, narrow):
    monkeypatch.setattr(pii, "NARROW", narrow)
    rows = [("email", f"{a}@{b}.c", "n") for a in "abcdefgh" for b in "abcdefgh"] + [("ssn", f"{k:09}", "n") for k in range(300)] + [("ip", f"10.0.{k}.1", "n") for k in range(50)] + [("card", f"{4 * 10**15 + k}", "n") for k in range(50)]
    rows += [("phone", f"+49{30 * 10**7 + k}", "n") for k in range(50)] + [("name.latin", f"name{k}", "mfn"[k % 3]) for k in range(200)]
    got = pii.assign(spark.createDataFrame(rows, "type string, entity string, gender string"), "key").collect()
    assert len(got) == len({(r.type, r.surrogate) for r in got}) == len(rows)
    assert not {(r.type, r.entity) for r in got} & {(r.type, r.surrogate) for r in got}
    assert all(len(r.surrogate) > len(r.entity) for r in got if r.type in ("ssn", "card", "phone", "ip")) == (narrow == 0)


# ---- 6 ----


@pytest.mark.parametrize(("limit", "bits"), [(500, 20), (2000, 2), (10**9, 20), (3000, None), (1, 3)])
def test_shards_fit(docs, nothing, limit, bits):
    rows = sharding.shard(docs, limit, cell_bits=bits).collect()
    place = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    sizes = [(r[0], len((r[1] or "").encode())) for r in corpus()]
    want = []
    for d, n in sizes:
        for depth in range(61):
            mine = [(x, b) for x, b in sizes if place(x) >> (60 - depth) == place(d) >> (60 - depth)]
            total = sum(b for _, b in mine)
            if total <= limit or len(mine) == 1 or depth == 60:
                want.append((d, n, f"{place(d) >> (60 - depth):0{depth}b}" if depth else "", depth, total))
                break
    assert ordered(rows) == ordered(want)
    assert sharding.shard(nothing, limit).count() == 0


def test_directory_covers_each_slot_once(spark):
    cells = spark.createDataFrame([(k, 10 if k % 7 else 90, 2) for k in range(64)], "cell long, bytes long, docs long")
    closed, large = sharding.buckets(cells, 6, 100)
    rows = sharding.slots(closed, 6).collect()
    assert sorted(r.slot for r in rows) == list(range(64)) and large.count() == 0
    assert all(r.shard_bytes <= 100 and r.slot >> (6 - r.depth) == r.prefix for r in rows)


def test_shards_are_written_whole(spark, docs, nothing, tmp_path):
    sharding.write_shards(docs, 5000, f"file://{tmp_path}/shards")
    back = spark.read.option("basePath", f"file://{tmp_path}/shards").parquet(f"file://{tmp_path}/shards")
    assert ordered(back.select(*docs.columns).collect()) == ordered(docs.collect())
    assert back.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0 and back.select("shard").distinct().count() > 3
    sharding.write_shards(nothing, 10, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), 10, f"file://{tmp_path}/clash")


# ---- 7 ----


def test_secrets(spark, nothing):
    live, copied = "x9Kq2mPz7Lw4Rt8Vb3Nc6Yd1", "EXAMPLEkey0123456789abcXYZ"
    rows = [(1, f'é password: "abc" API_KEY = hunter22 AKIA{"Q" * 16} {"0f" * 13} {live}', "en", "s1")]
    rows += [(k, f"see {copied}", "en", f"s{k}") for k in range(2, 6)] + [(9, None, None, None), (10, "ſecret=abcdef1 token=short", "en", "s1"), (1, "other", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {(r.doc_id, i): [(s.kind, rows[0][1][s.start : s.end]) for s in r.found] for i, r in enumerate(secret_scan.scan(docs).collect()) if r.doc_id == 1 and r.found}
    assert list(found.values()) == [[(0, "API_KEY = hunter22"), (1, "AKIA" + "Q" * 16), (2, "0f" * 13), (3, live)]]
    others = [r.found for r in secret_scan.scan(docs).collect() if r.doc_id != 1]
    assert all(not f for f in others)
    clean = sorted((r.doc_id, r.text or "") for r in secret_scan.redact(docs).collect())
    assert (1, 'é password: "abc" <secret> <secret> <secret> <secret>') in clean and (2, f"see {copied}") in clean and len(clean) == len(rows)
    assert secret_scan.scan(nothing).count() == 0 and secret_scan.redact(nothing).count() == 0


def brute_secrets(rows):
    """Base spans and candidates by plain loops, and the candidates' owners."""
    def base(t):
        out = []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            out += [(m.start(), 0, m.end(), m[2])] * (len(m[2]) >= 6)
        for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
            out += [(m.start(), kind, m.end(), m[0]) for m in re.finditer(pattern, t) if len(m[0]) >= least]
        return sorted(out)

    def runs(t):
        letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
        at = 0
        while at < len(t):
            end = at
            while end < len(t) and t[end] in letters:
                end += 1
            value = t[at:end]
            counts = [value.count(c) / max(1, len(value)) for c in set(value)]
            if len(value) >= 20 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and -sum(p * math.log2(p) for p in counts) >= 3:
                yield at, 3, end, value
            at = max(end, at + 1)

    spans, owners = [], {}
    for _, t, _, source in rows:
        found = base(t or "")
        found += [x for x in runs(t or "") if not any(b[0] < x[2] and x[0] < b[2] for b in found)]
        spans.append(found)
        for x in found:
            owners.setdefault(x[3], set()).add(source or "")
    return [[x[:3] + (len(owners[x[3]]) >= 3,) for x in sorted(found) if x[1] < 3 or len(owners[x[3]]) < 3] for found in spans]


@pytest.mark.parametrize("seed", [1, 2])
def test_secrets_are_those_of_plain_loops(spark, seed):
    rng = random.Random(seed)
    values = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789", k=rng.randrange(18, 400))) for _ in range(12)]
    pieces = ["password: ", "API_KEY=\"", "token = 'ab12cd'", "secret", "AKIA" + "Z9" * 8, "AKIAshort", "0123456789abcdef" * 2, "plain words é", "日本", "\n", "--", "=", "passwd:x"]
    rows = [(k, "".join(rng.choice([*pieces, " ", rng.choice(values)]) for _ in range(rng.randrange(30))), "en", rng.choice(["s1", "s2", "s3", "s4", None])) for k in range(150)]
    rows += [(200, None, None, None), (201, "", "en", "s1")] + [(7777, f"copy {values[0]}", "en", "s1")] * 40
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()
    want = [(r[0], tuple(map(tuple, spans))) for r, spans in zip(rows, brute_secrets(rows))]
    assert ordered((r.doc_id, tuple((s.start, s.kind, s.end, s.example) for s in r.found)) for r in got) == ordered(want)


def test_rows_that_a_table_cannot_concern(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).union(spark.createDataFrame([(-1, None)], "id long, h long"))
    table = spark.range(0, 20_000, 50).select(F.xxhash64("id").alias("g"))
    got = {r.id: r.perhaps for r in common.perhaps_in(rows, "h", table, "g", "perhaps").collect()}
    assert all(got[k] for k in range(0, 20_000, 50)) and not got[-1] and sum(got.values()) < 450 and len(got) == 20_001
    assert not any(r.perhaps for r in common.perhaps_in(rows, "h", table.limit(0), "g", "perhaps").collect())


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, k) for k in range(2, 50)] + [(None, 0)], "key long, n long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(40)], "key long, v string")
    for how, n in (("inner", 3038), ("left", 3049)):
        out = common.spread_join(rows, table, ["key"], how)
        assert out.count() == n and out.columns == ["key", "n", "v"] and {r.v for r in out.where("key = 1").collect()} == {"v1"}
    plan = common.spread_join(rows, table, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_spread_part" in plan
    # a table that is dealt by the key already doesn't undo the parts
    grouped = table.groupBy("key").agg(F.max("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = common.spread_join(rows, grouped, ["key"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt.count("hashpartitioning(key") >= 2 and dealt.count("_spread_part#") and re.search(r"hashpartitioning\(key#\d+L?, _spread_part#\d+", dealt)


@pytest.mark.parametrize("size", [256, 257, 342, 5000])
def test_long_runs_are_candidates(size):
    run = "".join(random.Random(size).choices("abcdefghijkXYZ0123456789_-", k=size))
    assert [x[:3] for x in secret_scan.find(f"see {run}.")[1]] == [(4, 3, 4 + size)]


# ---- 8 ----


def test_quality_measures(docs, nothing):
    def measure(t):
        t = t or ""
        w = split(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if split(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)

    want = [(r[0], *(m := measure(r[1])), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in corpus()]
    got = quality.judge(docs)
    assert ordered(got.select("doc_id", *quality.MEASURES, "base_failed").collect()) == ordered(want)
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.collect())
    assert quality.judge(nothing).count() == 0


def test_verdicts_can_be_filtered_and_names_do_not_clash(spark):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").withColumns({"judged": F.lit("mine"), "__n_words": F.lit(7), "Kept": F.lit("old")})
    start = time.time()
    judged = quality.judge(text)
    assert judged.where("kept and n_words > 20").count() == sum(r.kept and r.n_words > 20 for r in judged.collect()) > 0
    assert judged.where("size(broken) > 1").count() < judged.where(~F.col("kept")).count()
    assert time.time() - start < 40
    assert judged.columns[:3] == ["text", "judged", "__n_words"] and {(r.judged, r["__n_words"]) for r in judged.collect()} == {("mine", 7)}
    assert sorted({x for r in judged.collect() for x in r.broken} - {r.name for r in quality.RULES}) == []


# ---- 9 ----


def test_mix_meets_targets(docs, nothing):
    rows = mixing.mix(docs).collect()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(r.size for r in rows if r.source == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left = {}, set(names)
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left.discard(s)
    target |= share
    for r in rows:
        assert math.isclose(r.target, target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
    for s in names:
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 200  # tied rows at the cut
    assert ordered(rows) == ordered(mixing.mix(docs).collect())
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize(("copies", "words"), [(200, 5), (200, 1), (3, 1000)])
def test_equal_rows_share_a_target(spark, copies, words):
    rows = [(1, "w " * words, "a", 1)] * copies + [(k, "other words here " * 9, "b", 1) for k in range(2, 30)] + [(None, None, None, 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size_ int").repartition(7)
    out = mixing.mix(docs).collect()
    for source in ("a", "b", None):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - (mine[0].target or 0)) <= 1 and all(0 <= r.taken <= 3 * r.size for r in mine)
    assert len(out) == len(rows) and ordered(out) == ordered(mixing.mix(docs).collect())


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "k", 5, "r"), (2, "c", "s", "k", 5, "r")], "doc_id long, text string, source string, `__key` string, Taken int, row string")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "__key", "row", "size", "source_size", "target", "taken", "copies"]
    assert {(r["__key"], r["row"]) for r in out.collect()} == {("k", "r")}


# ---- 10 ----


def test_avi_round_trip(docs, nothing):
    text = {x[0]: (x[1] or "").encode() for x in corpus()}
    assert all(avi.read(bytes(r.avi)) == avi.pad(text[r.doc_id]) for r in avi.media(docs).collect())
    assert avi.media(nothing).count() == 0 and avi.clips(avi.media(nothing)).count() == 0
    for payload in (bytes(range(256)) * 7, b"\xff" * 640, bytes(64), bytes(512 * 3)):
        data = avi.write(payload)
        assert avi.read(data) == payload
        frames = avi.read_frames(data)[0]
        slow = [avi.coefficients(f)[0].reshape(-1, 64) for f in frames]
        assert b"".join(map(avi._bytes, slow)) == payload
        # all frames at once give what each gives code by code, down to the samples
        head, coded = avi._aligned(frames)
        assert (np.pad(coded, ((0, 0), (0, 64 - coded.shape[1]))) == np.concatenate(slow)).all()
        assert np.allclose(avi.histograms(frames), np.concatenate([avi._histograms(avi.luminance(f).reshape(1, -1)) for f in frames]))
    assert avi._digest(b"abc")[3] == zlib.crc32(avi.pad(b"abc")[-64:])


def test_samples_are_those_of_the_inverse_transform():
    block = np.zeros((1, 64), dtype=np.int16)
    block[0, 0], block[0, 1], block[0, 5] = 40, -30, 17
    quant = np.arange(1, 65, dtype=np.float32)
    scale = lambda k: math.sqrt(0.5) if k == 0 else 1
    for y in range(8):
        for x in range(8):
            total = 0
            for k in (0, 1, 5):
                v, u = avi.ZIGZAG[k]
                total += scale(u) * scale(v) / 4 * block[0, k] * quant[k] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
            assert abs(avi._levels(block, quant)[0, 8 * y + x] - min(255, max(0, total + 128))) <= 0.51
    assert avi.ZIGZAG[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)] and avi.ZIGZAG[63] == (7, 7)


def foreign_jpegs(spark, pictures, grey):
    """The frames as another encoder writes them, and the luminance that its decoder gives."""
    jvm = spark.sparkContext._jvm
    image_io, kind = jvm.javax.imageio.ImageIO, jvm.java.awt.image.BufferedImage
    out = []
    for pixels in pictures:
        high, wide = len(pixels), len(pixels[0])
        image = kind(wide, high, kind.TYPE_BYTE_GRAY if grey else kind.TYPE_INT_RGB)
        for y in range(high):
            for x in range(wide):
                image.setRGB(x, y, pixels[y][x])
        sink = jvm.java.io.ByteArrayOutputStream()
        assert image_io.write(image, "jpg", sink)
        data = bytes(sink.toByteArray())
        back = image_io.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
        out.append((data, [[[back.getSample(x, y, b) for b in range(back.getNumBands())] for x in range(wide)] for y in range(high)]))
    return out


def foreign_avi(frames, index=True, absolute=False):
    chunks = [avi._chunk(b"00dc", f) for f in frames]
    head = avi._list(b"hdrl", avi._chunk(b"avih", struct.pack("<14I", 50_000, *[0] * 13)))
    movi = avi._list(b"movi", b"".join(chunks))
    at = 4 + (12 + len(head) + 8 if absolute else 0)
    idx = b""
    for f, c in zip(frames, chunks):
        idx += b"00dc" + struct.pack("<III", 16, at, len(f))
        at += len(c)
    body = b"AVI " + head + movi + (avi._chunk(b"idx1", idx) if index else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("grey", [True, False])
def test_frames_of_another_encoder(spark, grey):
    """Pictures whose sides aren't multiples of eight, from an encoder with subsampled colour, against its own decoder."""
    rgb = lambda r, g, b: (r << 16 | g << 8 | b) - (1 << 24)
    night = [[rgb(10 + (x * y) % 23, 20, 30 + x) for x in range(37)] for y in range(21)]
    day = [[rgb(200 + (x + y) % 50, 210 - x, 190) for x in range(37)] for y in range(21)]
    made = foreign_jpegs(spark, [night, night, day, day, day], grey)
    for data, samples in made:
        got = avi.luminance(data)
        want = np.array([[p[0] if grey else 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] for p in row] for row in samples])
        assert got.shape == want.shape and np.abs(got - want).mean() < 1.5
    frames = [d for d, _ in made]
    for data in (foreign_avi(frames), foreign_avi(frames, absolute=True), foreign_avi(frames, index=False)):
        rows = avi.clips(spark.createDataFrame([(1, bytearray(data))], "doc_id long, avi binary")).orderBy("clip").collect()
        assert [tuple(r)[2:] for r in rows] == [(0, 1, 0, 100), (2, 4, 100, 250)]
    # a frame without tables of its own is read by the standard ones, which this encoder uses
    bare, at = frames[0][:2], 2
    while frames[0][at + 1] != 0xDA:
        size = 2 + struct.unpack_from(">H", frames[0], at + 2)[0]
        bare += b"" if frames[0][at + 1] == 0xC4 else frames[0][at : at + size]
        at += size
    assert (avi.luminance(bare + frames[0][at:]) == avi.luminance(frames[0])).all()
    for broken in (frames[0][: len(frames[0]) // 2], b"no frame"):
        with pytest.raises(ValueError):
            avi.luminance(broken)


def test_shots_are_timed(spark):
    payload = b"\x10" * 2048 + (b"\x10" * 4 + b"\xe0" * 4) * 128 + b"\x7f" * 512
    rows = avi.clips(spark.createDataFrame([(1, bytearray(avi.write(payload))), (2, None)], "doc_id long, avi binary")).orderBy("clip").collect()
    assert [tuple(r)[2:] for r in rows] == [(0, 3, 0, 160), (4, 5, 160, 240), (6, 6, 240, 280)]


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.materialize(stage(spark, kept, ""), "stage")
        assert kept.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert last.count() == kept.count()
