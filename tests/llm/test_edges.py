"""Nulls in any column, empty tables, repeated rows, long texts and columns whose names could clash, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tidelog.llm import avi, bpe, mixing, ngram_lm, pii, quality, secret_scan, sharding, simhash, substring_dedup

CLASHING = "row id key size hash text_hash k t a b new known spans found again gone doc of cut part slot judged kept_ __a __n_words __size _spread_part block blob words".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING) + ", `dot.ted` int"


def table():
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    texts = ["plain words that are the same in two rows of the table and more", None, "", " \t\n", "x" * 50_000, long, "Mr. Smith, password=hunter2222 and mail a@b.example AKIA" + "Q" * 16, "\x00 odd   characters \U0001f600 é"]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (0, texts[0], None, None), (None, texts[0], "en", "s0"), (None, None, None, None), (9, texts[0], "de", "s1")]
    return [(*r, 1, *(f"{c}!" for c in CLASHING), 5) for r in rows] + [(50, texts[0], *[None] * (len(CLASHING) + 4))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


VOCAB, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Those that carry the columns of their input, with the columns that they add, and the rest.
CARRY = {
    "encode": (lambda d: bpe.encode(d, VOCAB, PATTERN, chunked=True), 4),
    "pseudonymize": (lambda d: pii.pseudonymize(d, "key"), 1),
    "judge": (quality.judge, 8),
    "redact": (secret_scan.redact, 0),
}
ROWS = {
    "near_duplicates": simhash.near_duplicates,
    "score": ngram_lm.score,
    "remove_repeats": substring_dedup.remove_repeats,
    "shard": lambda d: sharding.shard(d, 1000),
    "scan": secret_scan.scan,
    "media": avi.media,
}


@pytest.mark.parametrize("name", CARRY)
def test_carried_columns_stay(docs, nothing, name):
    f, added = CARRY[name]
    out = f(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + added
    want = sorted((tuple(r[2:]) for r in table()), key=repr)
    assert sorted((tuple(r) for r in out.select(*(F.col(f"`{c}`") for c in docs.columns[2:])).collect()), key=repr) == want
    assert f(nothing).count() == 0


@pytest.mark.parametrize("name", ROWS)
def test_one_result_a_row(docs, nothing, name):
    got = sorted((r.doc_id for r in ROWS[name](docs).collect()), key=repr)
    assert got == sorted((r[0] for r in table()), key=repr)
    assert ROWS[name](nothing).count() == 0


def test_mix_carries_all_but_its_own(docs, nothing):
    out = mixing.mix(docs)
    assert [c for c in docs.columns if c != "size"] == out.columns[:-5] and out.count() == len(table())
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, nothing, stage):
    f = corpus_pipeline.STAGES[stage][1]
    out = f(spark, docs, "")
    assert out.columns[: len(docs.columns)] == docs.columns or stage == 4
    kept = out.collect()
    assert all(r["dot.ted"] == 5 or r["row"] is None for r in kept)
    if stage == 1:
        # null and wordless rows, those without an id, and one of the equal texts
        assert sorted((r.doc_id for r in kept), key=repr) == sorted([0, 1, 2, 3, 4, 5, 6, 7, None, None], key=repr)
    if stage in (2, 4):
        assert len(kept) == len(table())
    if stage == 2:
        assert not any("hunter2222" in (r.text or "") for r in kept)
    assert f(spark, nothing, "").count() == 0
