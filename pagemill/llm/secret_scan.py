"""Secrets in texts: known forms, and strings of high local entropy.

Known forms are found by pattern. Other candidates are runs of at least
``WINDOW`` characters of the base-64 and URL alphabets. A window slides over a
candidate; the counts of its characters change by one in and one out, and with them
the sum of c * log2(c) that gives the window's Shannon entropy. Hexadecimal and other
candidates have thresholds of their own. The span from the first to the last window
over the threshold is a secret. Two allow lists suppress what is none: a stretch that is all
words, numbers or dates (``ALLOWED``), and windows that overlap a word that marks a placeholder
(``MARKERS``); a candidate is cut at these, and the stretches between them are judged by themselves.

Positions are code points, ends exclusive. Null and empty texts have no spans. Equal
rows get equal results; an empty table gives an empty one. Other columns are passed
on; names that the result adds are refused if the table has them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
# Words, numbers, dates and identifiers of words.
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[-_/+=]*[A-Za-z]+([-_/+=]+[A-Za-z]+)*[-_/+=]*$",
)
# Words that stand in for a secret.
MARKERS = r"(?i:example|placeholder|xxxxxx)"
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Sums of c * log2(c) are kept in millionths, as whole numbers.
UNIT = 1_000_000
_PREFIX_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A known form; ``least`` is the number of characters that ``group`` must have."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# A run that is long enough is found in full by its least length, so short runs,
# which any text is full of, need not be listed to be dropped.
KINDS = (
    Kind("assign", ASSIGN, 1, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", r"[0-9a-f]{32,}"),
)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _before(numbers: Column) -> Column:
    """Sums of the numbers before each place, by blocks: not quadratic in long arrays."""
    block = F.lit(_PREFIX_BLOCK)

    def with_blocks(n: Column) -> Column:
        count = F.ceil(F.size(n) / _PREFIX_BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _total(F.slice(n, b * _PREFIX_BLOCK + 1, block)))
        return _bound(
            _bound(sums, lambda s: F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b)))),
            lambda starts: F.transform(
                n,
                lambda _, i: F.get(starts, F.floor(i / _PREFIX_BLOCK).cast("int"))
                + _total(F.slice(n, F.floor(i / _PREFIX_BLOCK).cast("int") * _PREFIX_BLOCK + 1, i % _PREFIX_BLOCK)),
            ),
        )

    return _bound(numbers, with_blocks)


def occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: ``start``, ``found`` and the ``part`` of a group.

    What lies between matches and the matches alternate, so their lengths add up to
    the positions.
    """

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.char_length(g) + F.char_length(m))
        rows = F.zip_with(
            F.arrays_zip(_before(steps).alias("b"), gaps.alias("g")),
            F.arrays_zip(found.alias("m"), parts.alias("p")),
            lambda x, y: F.struct(
                (x["b"] + F.char_length(x["g"])).alias("start"), y["m"].alias("found"), y["p"].alias("part")
            ),
        )
        return F.when(F.size(found) > 0, F.slice(rows, F.lit(1), F.size(found)))

    none = F.array().cast("array<struct<start:int,found:string,part:string>>")
    return F.coalesce(_bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), none)


def _spans(found: Column, rank: int, name: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (m["start"] + F.char_length(m["found"])).alias("end"),
            F.lit(name).alias("kind"),
        ),
    ).cast(SPAN)


def known_spans(text: Column, rank: int, kind: Kind) -> Column:
    found = occurrences(text, kind.pattern, kind.group)
    if kind.least:
        found = F.filter(found, lambda m: F.char_length(m["part"]) >= kind.least)
    return _spans(found, rank, kind.name)


def _most_repetition(bits: float) -> int:
    """The greatest sum of c * log2(c) of a window whose entropy reaches ``bits``."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


def high_windows(candidate: Column, hex_bits: float, other_bits: float) -> Column:
    """First and last start of windows over the threshold, as a struct; null if none."""
    terms = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0) for c in range(WINDOW + 2)])
    allowed = F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(_most_repetition(hex_bits)))
    allowed = allowed.otherwise(F.lit(_most_repetition(other_bits)))
    codes = F.transform(F.split(candidate, "(?<=.)(?=.)"), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def slide(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            code, old = F.get(codes, i), F.get(codes, i - WINDOW)
            counts = F.transform(
                s["counts"],
                lambda n, k: n + F.when(k == code, 1).otherwise(0) - F.when(k == old, 1).otherwise(0),
            )
            # In and out of the same character leaves all counts; otherwise one rises and one falls.
            up, down = F.get(s["counts"], code), F.get(s["counts"], old)
            gain = F.get(terms, up + 1) - F.get(terms, up)
            loss = F.coalesce(F.get(terms, down) - F.get(terms, down - 1), F.lit(0))
            total = s["sum"] + F.when(code == old, F.lit(0)).otherwise(gain - loss)
            total = F.when(old.isNull(), s["sum"] + gain).otherwise(total)
            return F.struct(counts.alias("counts"), total.alias("sum"), s["first"].alias("first"), s["last"].alias("last"), i.alias("i"))

        def mark(s: Column) -> Column:
            at = s["i"] - (WINDOW - 1)
            high = (at >= 0) & (s["sum"] <= allowed)
            return F.struct(
                s["counts"].alias("counts"),
                s["sum"].alias("sum"),
                F.when(high, F.coalesce(s["first"], at)).otherwise(s["first"]).alias("first"),
                F.when(high, at).otherwise(s["last"]).alias("last"),
            )

        places = F.sequence(F.lit(0), F.size(codes) - 1)
        return F.aggregate(
            places,
            start,
            lambda s, i: _bound(step(s, i), mark),
            lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"))),
        )

    return _bound(codes, slide)


def _between(candidate: Column, start: Column, markers: str) -> Column:
    """Stretches of a candidate that hold no marker: ``start`` and ``found``."""

    def cut(parts: Column) -> Column:
        words = F.regexp_extract_all(candidate, F.lit(markers), F.lit(0))
        none = F.lit("")
        steps = F.zip_with(
            parts, words, lambda p, w: F.char_length(F.coalesce(p, none)) + F.char_length(F.coalesce(w, none))
        )
        return F.zip_with(
            _before(steps), parts, lambda at, part: F.struct((start + at).alias("start"), part.alias("found"))
        )

    whole = F.array(F.struct(start.alias("start"), candidate.alias("found")))
    return F.when(candidate.rlike(markers), _bound(F.split(candidate, markers, -1), cut)).otherwise(whole)


def entropy_spans(
    text: Column,
    rank: int,
    hex_bits: float = 3.0,
    other_bits: float = 3.7,
    allowed: tuple[str, ...] = ALLOWED,
    markers: str = MARKERS,
) -> Column:
    """Spans of kind ``entropy``: a candidate's stretch of windows over the threshold."""

    def listed(candidate: Column) -> Column:
        out = F.char_length(candidate) < WINDOW
        for pattern in allowed:
            out = out | candidate.rlike(pattern)
        return out

    cut = F.flatten(F.transform(occurrences(text, CANDIDATE), lambda m: _between(m["found"], m["start"], markers)))
    found = F.filter(cut, lambda m: ~listed(m["found"]))
    scored = F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), high_windows(m["found"], hex_bits, other_bits).alias("w")),
    )
    return F.transform(
        F.filter(scored, lambda m: m["w"].isNotNull()),
        lambda m: F.struct(
            (m["start"] + m["w"]["first"]).alias("start"),
            F.lit(rank).alias("rank"),
            (m["start"] + m["w"]["last"] + WINDOW).alias("end"),
            F.lit("entropy").alias("kind"),
        ),
    ).cast(SPAN)


def scan_documents(docs: DataFrame, text_column: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``base_spans`` (known forms) and ``secret_spans`` (all), each sorted by
    start, then kind."""
    if clash := {"base_spans", "secret_spans", "_entropy"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    text = F.coalesce(F.col(text_column), F.lit(""))
    known = [known_spans(text, rank, kind) for rank, kind in enumerate(KINDS)]
    out = docs.withColumns(
        {"base_spans": F.sort_array(F.concat(*known)), "_entropy": entropy_spans(text, len(KINDS), allowed=allowed)}
    )
    return out.withColumn("secret_spans", F.sort_array(F.concat("base_spans", "_entropy"))).drop("_entropy")


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        gap = F.array(F.struct(s["at"].alias("a"), x["start"].alias("b")))
        # Touching or overlapping spans share one mark; the first may begin the text.
        new = (x["start"] > s["at"]) | ((x["start"] == 0) & (F.size(s["kept"]) == 0))
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"), F.when(new, F.concat(s["kept"], gap)).otherwise(s["kept"]).alias("kept")
        )

    def joined(s: Column) -> Column:
        pieces = F.transform(s["kept"], lambda k: F.substring(text, k["a"] + 1, k["b"] - k["a"]))
        tail = F.substring(text, s["at"] + 1, F.char_length(text))
        return F.concat(F.array_join(F.concat(pieces, F.array(F.lit(""))), mark), tail)

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, joined)).otherwise(text)
