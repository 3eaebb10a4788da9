"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean column: true rejects the document.  On a bounded sample
each rule's cost (seconds of a job that evaluates it alone, above a job that
only reads the text) and selectivity (share rejected) are measured; rules with
more rejections per cost come first, and a CASE ends at the first that rejects.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Rows on which rules are costed; they set the order of the rules only.
SAMPLE_ROWS = 2000
WORDS = "__words"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; an empty array for a text without any."""
    return let(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \t-\r]+")),
    )


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(_worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, in n log n steps.

    Windows are hashed; if no two hashes agree the count is zero.  Else windows
    are sorted by hash, those equal to a neighbour give the places, and each
    place in order covers as many words as lie before the next, at most three.
    """
    hashes = lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    equal = lambda s, at, x: F.get(s, at)["h"].eqNullSafe(x["h"])
    repeated = lambda s: F.sort_array(
        F.transform(F.filter(s, lambda x, i: equal(s, i - 1, x) | equal(s, i + 1, x)), lambda x: x["i"])
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)),
        F.lit(0),
        lambda a, x: a + x,
    )
    of_hashes = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(let(placed(h), repeated), covered)
    )
    return let(words, lambda w: let(hashes(w), of_hashes)).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text and its words and is true for a document to drop."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _shouting(text: Column) -> Column:
    letters = F.char_length(F.regexp_replace(text, "\\P{L}+", ""))
    small = F.char_length(F.regexp_replace(text, "[^\\p{L}]+|\\p{Lu}+", ""))
    return 2 * (letters - small) > letters


RULES = (
    Rule("few_words", lambda t, w: n_words(w) < MIN_WORDS),
    Rule("symbols", lambda t, w: 10 * n_symbols(t) > n_words(w)),
    Rule("short_words", lambda t, w: 2 * word_chars(w) < 5 * n_words(w)),
    Rule("long_words", lambda t, w: word_chars(w) > 12 * n_words(w)),
    Rule("shouting", lambda t, w: _shouting(t)),
    Rule("repeated_lines", lambda t, w: let(_worded_lines(t), lambda x: 2 * F.size(F.array_distinct(x)) < F.size(x))),
    Rule("repeated_words", lambda t, w: 100 * n_repeat_words(w) > MAX_REPEAT_PERCENT * n_words(w)),
)


@dataclass(frozen=True)
class Costed:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-3)


def _rejects(rule: Rule) -> Column:
    return F.coalesce(rule.rejects(text_of(), F.col(WORDS)), F.lit(False))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Costed]:
    """The rules, best rejection per cost first, as measured on about ``sample_rows`` rows."""
    # a share of the rows, where they are: limit() would gather rows of every partition in one
    share = min(1.0, sample_rows / max(1, docs.count()))
    texts = docs.select(F.col("text").cast("string").alias("text")).sample(share, seed=7)
    sample = stored(texts.withColumn(WORDS, words_of(text_of())), "rule-sample")

    def timed(column: Column) -> tuple[float, int]:
        began = time.perf_counter()
        row = sample.agg(F.count_if(column).alias("n"), F.count("*").alias("rows")).first()
        return time.perf_counter() - began, row.n / max(1, row.rows)

    timed(F.char_length(text_of()) + F.size(WORDS) < 0)  # warm
    base = timed(F.char_length(text_of()) + F.size(WORDS) < 0)[0]
    costed = []
    for rule in rules:
        seconds, rejected = timed(_rejects(rule))
        costed.append(Costed(rule, max(0.0, seconds - base), rejected))
    return sorted(costed, key=lambda c: (-c.worth, c.seconds))


def cascade(ordered: list[Costed]) -> Column:
    """True for a document that no rule rejects; evaluation ends at the first that does."""
    kept = F.lit(True)
    for costed in reversed(ordered):
        kept = F.when(_rejects(costed.rule), F.lit(False)).otherwise(kept)
    return kept


def with_verdict(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``kept`` (boolean), which replaces a column of that name.

    A null text counts as empty: no words, rejected by ``few_words``.  Each row is
    judged by itself, so repeated rows and ties are alike; an empty table stays
    empty; other columns pass through.
    """
    ordered = order_rules(docs, rules, sample_rows)
    return docs.withColumn(WORDS, words_of(text_of())).withColumn("kept", cascade(ordered)).drop(WORDS)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``.

    Null and empty texts have too few words to stay; repeated rows stay or go
    together, null ids too; an empty table gives no rows.
    """
    ordered = order_rules(docs, rules, sample_rows)
    return docs.withColumn(WORDS, words_of(text_of())).filter(cascade(ordered)).drop(WORDS)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document the counts behind the rules, ``base_failed`` and ``kept``; ``docs`` has doc_id and text.

    Documents that fail the base need no other rule: the cascade runs after it.
    """
    ordered = [c for c in order_rules(docs, rules, sample_rows) if c.rule.name not in ("few_words", "repeated_words")]
    words, text = F.col(WORDS), text_of()
    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn(WORDS, words_of(text))
    counted = counted.select(
        "doc_id",
        "text",
        WORDS,
        n_words(words).alias("n_words"),
        word_chars(words).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        n_repeat_words(words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered))
    return counted.withColumn("kept", kept).drop("text", WORDS)
