"""Quality rules: a table of thresholds compiled into one Spark expression, no user functions.

All measures of a text are one struct, in which a value that several others use is bound once
(a function over an array of one element), so the expression grows with the rules, not with
their nesting: it can be filtered on, pushed down and evaluated again like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this "
    "de la que en el los se una por le les des et un est pour "
    "der die und das den von zu mit im nicht ein eine"
).split()


@dataclass(frozen=True)
class Rule:
    """`part` in per cent of `whole` (without whole: part itself) must lie in [least, most]; judged from min_words words on."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None
    min_words: int = 0


#: part and whole: fields of `measures`.
RULES = (
    Rule("length", "n_words", None, 10, 5_000_000),
    Rule("repeats", "n_repeat_words", "n_words", None, 20),
    Rule("word_length", "word_chars", "n_words", 200, 2000, 10),
    Rule("symbols", "n_symbols", "n_words", None, 30, 10),
    Rule("stop_words", "n_stop_words", "n_words", 1, None, 80),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 50, 10),
)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words (long); null text counts as empty.

    Windows are compared by a 64-bit hash first; only a text in which two hashes agree has its
    windows compared as strings.
    """

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, common.GAP), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, common.GAP_CHARS, "") != "")
        return _bind(words, lambda w: _bind(lines, lambda x: fields(t, w, x)))

    def fields(t: Column, words: Column, lines: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.translate(t, common.GAP_CHARS, "")),
            "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
            "n_repeat_words": _repeat_words(words),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in values.items()))

    return _bind(F.coalesce(text, F.lit("")), of)


def _repeat_words(words: Column) -> Column:
    """How many words lie in a five-word window that is there twice or more."""
    starts = F.sequence(F.lit(0), F.size(words) - 5)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
    strings = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 5)).alias("w"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        # equal windows are neighbours in sorted order
        hit = F.transform(pairs, lambda x, k: F.when((x["w"] == F.get(pairs, k - 1)["w"]) | (x["w"] == F.get(pairs, k + 1)["w"]), x["i"]))
        return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)

    suspect = _bind(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    exact = _bind(strings, lambda pairs: _bind(repeated(pairs), covered))
    return F.when(F.size(words) > 5, F.when(suspect, exact).otherwise(0)).otherwise(0)


def broken(measured: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that measures break, as an array; a rule whose whole is zero isn't broken."""
    names = []
    for rule in rules:
        part, whole = (measured[rule.part], F.lit(1)) if rule.whole is None else (100 * measured[rule.part], measured[rule.whole])
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (part < rule.least * whole)
        if rule.most is not None:
            bad = bad | (part > rule.most * whole)
        names.append(F.when((measured["n_words"] >= rule.min_words) & (whole > 0) & bad, F.lit(rule.name)))
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def assess(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures, base_failed, kept (boolean) and broken (array of rule names)."""

    def whole(m: Column, names: Column) -> Column:
        base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*(m[k].alias(k) for k in MEASURES), base_failed.alias("base_failed"), (~base_failed & (F.size(names) == 0)).alias("kept"), names.alias("broken"))

    return _bind(measures(text), lambda m: _bind(broken(m, rules), lambda names: whole(m, names)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = (*MEASURES, "base_failed", "kept", "broken")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with the five measures (long), base_failed, kept (boolean) and broken (array of rule names).

    Null text counts as empty: no words, base_failed, not kept. Columns of docs with those names
    give way; others stay, whatever their names. Repeated rows are judged each; empty in, empty out.
    """
    (own,) = common.fresh(docs, "judged")
    rows = docs.withColumn(own, assess(F.col(f"`{text_col}`"), rules))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in VERDICT]
    return rows.select(*kept, *(F.col(own)[k].alias(k) for k in VERDICT))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that break no rule, with their columns; null or empty texts go, repeated rows stay."""
    return docs.where(assess(F.col(f"`{text_col}`"), rules)["kept"])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *MEASURES, "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM s) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 5000000 AND NOT (n_words >= 10 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 20.0))
  AND NOT (n_words >= 10 AND n_symbols / n_words > 0.3) AND NOT (n_words >= 80 AND n_stop / n_words < 0.01) AND NOT (n_words >= 10 AND n_dup_lines / n_lines > 0.5) AS kept
FROM b
"""
