"""Quality rules as a cascade that stops at the first rule that rejects a text.

On a bounded sample each rule's cost (seconds to evaluate it alone) and
selectivity (share it rejects) are measured, and rules run in order of rejection per
cost. A ``CASE`` in that order evaluates a rule only for what all earlier ones let
pass. The order changes what is computed, and never which texts are kept.

Words are maximal runs without white space (U+0020, U+0009 to U+000D). A null or empty
text has no words and fails the rule of least words. Equal rows get equal
results; an empty table gives an empty one. Other columns are passed on; names that
the result adds are refused if the table has them. Repeated windows are found by
64-bit hashes of three words, compared within one text only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize

SPACE_CHARS = " \t\n\x0b\f\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Words as an array; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(parts, lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    return _bound(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words within windows that occur at least twice."""

    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - window)
        grams = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) >= window, grams).otherwise(F.array().cast("array<bigint>"))

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        start = F.struct(F.lit(-window).alias("at"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            _bound(placed, repeats),
            start,
            lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(window), i - s["at"])).alias("n")),
            lambda s: s["n"],
        )

    # Most texts repeat no window: only the others are sorted.
    return _bound(
        _bound(words, hashes),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(g)),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the statistics in ``needs`` and the text."""

    name: str
    rejects: Callable[[dict[str, Column], Column], Column]
    needs: tuple[str, ...] = ()


def _upper_share(stats: dict[str, Column], text: Column) -> Column:
    letters = F.char_length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return letters * 2 > stats["word_chars"]


def _line_share(stats: dict[str, Column], text: Column) -> Column:
    return stats["n_dup_lines"] * 2 > F.size(_lines(text))


BASE_RULES = (
    Rule("few_words", lambda s, t: s["n_words"] < 50, ("n_words",)),
    Rule("repeated_windows", lambda s, t: s["n_repeat_words"] * 100 > s["n_words"] * 50, ("n_repeat_words", "n_words")),
)
RULES = (
    Rule("symbols", lambda s, t: s["n_symbols"] * 10 > s["n_words"], ("n_symbols", "n_words")),
    Rule(
        "word_length",
        lambda s, t: (s["word_chars"] < s["n_words"] * 3) | (s["word_chars"] > s["n_words"] * 12),
        ("word_chars", "n_words"),
    ),
    Rule("duplicate_lines", _line_share, ("n_dup_lines",)),
    Rule("capitals", _upper_share, ("word_chars",)),
)


def statistics(text: Column, words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(words),
        "n_symbols": symbol_count(text),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
    }


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rejected_per_second(self) -> float:
        return self.rejected / self.seconds


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_column: str = "text", sample_rows: int = 1000) -> list[Measured]:
    """Rules by falling share of rejected texts per second, on at most ``sample_rows`` texts."""
    sample = materialize(docs.select(F.col(text_column).alias("text")).limit(sample_rows), "rule-sample")
    text = F.col("text")
    stats = statistics(text, words_of(text))

    def timed(*columns: Column) -> tuple[float, tuple]:
        began = time.perf_counter()
        row = sample.agg(F.count("*").alias("n"), *columns).first()
        return time.perf_counter() - began, tuple(row)

    timed()
    base, (rows,) = timed()
    measured = []
    for rule in rules:
        seconds, (_, rejected) = timed(F.count_if(rule.rejects(stats, text)).alias("rejected"))
        measured.append(Measured(rule, max(seconds - base, 1e-3), rejected / max(rows, 1)))
    return sorted(measured, key=lambda m: -m.rejected_per_second)


def rejected_by(order: list[Measured], stats: dict[str, Column], text: Column) -> Column:
    """Name of the first rule in order that rejects the text, else null."""
    out = F.lit(None).cast("string")
    for m in reversed(order):
        out = F.when(m.rule.rejects(stats, text), F.lit(m.rule.name)).otherwise(out)
    return out


def filter_documents(docs: DataFrame, text_column: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects. No statistic is computed for a text after
    the rule that rejects it."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    order = order_rules(docs, (*BASE_RULES, *RULES), text_column, sample_rows)
    # The words are cut once for all rules.
    return docs.where(_bound(words_of(text), lambda w: rejected_by(order, statistics(text, w), text)).isNull())


def score_documents(docs: DataFrame, text_column: str = "text", sample_rows: int = 1000) -> DataFrame:
    """``docs`` with the statistics of every text, ``base_failed``, ``rejected_by`` and
    ``kept``. Rules beyond the base ones run for texts that those let pass."""
    if clash := {*STATS, "base_failed", "rejected_by", "kept", "_words"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    text = F.coalesce(F.col(text_column), F.lit(""))
    order = order_rules(docs, RULES, text_column, sample_rows)
    scored = docs.withColumn("_words", words_of(text)).withColumns(statistics(text, F.col("_words"))).drop("_words")
    stats = {name: F.col(name) for name in STATS}
    failed = [F.when(rule.rejects(stats, text), F.lit(rule.name)) for rule in BASE_RULES]
    scored = scored.withColumn("rejected_by", F.coalesce(*failed))
    scored = scored.withColumn("base_failed", F.col("rejected_by").isNotNull())
    verdict = F.when(F.col("base_failed"), F.col("rejected_by")).otherwise(rejected_by(order, stats, text))
    return scored.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
