"""From stage tables to numbered chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagemill.fixed_values import (
    NUM_PERM,
    PROMPT_ID_PREFIX,
    SAVE_NUM,
    THRESHOLD,
    WI_QUOTA,
    WR_QUOTA,
)
from pagemill.functions.messages import wi_messages, wr_messages
from pagemill.operators.filters import filter_counts, filter_special_pattern
from pagemill.operators.neardup import surviving_rows
from pagemill.operators.numbering import position_cutoffs
from pagemill.operators.selection import PAGE_NUMBERS, page_numbers, page_of_numbers, select_mix
from pagemill.session import MAX_BROADCAST_ROWS, materialize


def clean_pool(
    pairs: DataFrame,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    tokens: str | None = None,
    report: Observation | None = None,
) -> DataFrame:
    """``(pool, seq, page)`` of the rows left by the filter and, after it, by
    near-duplicate removal.

    ``pairs`` holds ``pool, seq, webpage, request, response``, ``seq`` unique and
    in list order. One scan of the texts turns each row into hashes. ``tokens``
    names a column with token sets from a tokenizer of your own. ``report``
    receives the filter's counts per pool.
    """
    if report is not None:
        pairs = pairs.observe(report, *filter_counts())
    numbers = dict(zip(PAGE_NUMBERS, page_numbers(F.col("webpage"))))
    usable = filter_special_pattern(pairs).withColumns(numbers)
    token_column = None if tokens is None else F.col(tokens)
    rows = surviving_rows(usable, token_column, PAGE_NUMBERS, threshold, num_perm)
    return materialize(rows.select("pool", "seq", page_of_numbers().alias("page")), "survivors")


def number_mix(wi: DataFrame, wr: DataFrame, save_num: int = SAVE_NUM) -> DataFrame:
    """``(pool, seq, number)``: WI rows from 0, WR rows after them, cut at
    ``save_num``."""
    wi_rows = wi.select(F.count("*")).scalar()
    numbered = wi.select(F.lit("WI").alias("pool"), "seq", F.col("position").alias("number")).unionByName(
        wr.select(F.lit("WR").alias("pool"), "seq", (F.col("position") + wi_rows).alias("number"))
    )
    return numbered.filter(F.col("number") < save_num)


def assemble(
    pairs: DataFrame, numbered: DataFrame, rows: int, seed: str = "", most: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """``prompt_id, messages`` (with ``number`` to sort by) of the numbered rows.

    The text is joined back here, and only here: ``numbered`` has at most
    ``rows`` rows of ids and is broadcast, so that page text is scanned but not
    shuffled. More than ``most`` ids are taken in ranges of ``seq``, each joined with the
    rows of its range only and written before the next, so that the ids of one range at a time
    are in memory; the messages then lie in scratch space.
    """
    web, request, response = F.col("webpage"), F.col("request"), F.col("response")
    messages = F.when(F.col("pool") == "WI", wi_messages(web, request, response, F.col("seq"), seed)).otherwise(
        wr_messages(request, response)
    )

    def part(within: Column) -> DataFrame:
        joined = pairs.filter(within).join(F.broadcast(numbered.filter(within)), ["pool", "seq"])
        prompt_id = F.concat(F.lit(PROMPT_ID_PREFIX), "number").alias("prompt_id")
        return joined.select("number", prompt_id, messages.alias("messages"))

    if rows <= most:
        return part(F.lit(True))
    out = None
    for within in _ranges(numbered, most):
        written = materialize(part(within), "messages")
        out = written if out is None else out.unionByName(written)
    return out


def _ranges(numbered: DataFrame, most: int) -> list[Column]:
    """Conditions on ``seq`` that each hold for about ``most`` of the rows."""
    cutoffs = position_cutoffs(numbered.select("seq").distinct(), "seq", lambda n: list(range(most, n, most)))
    bounds = [None, *sorted({c for c in cutoffs if c is not None}), None]
    return [
        (F.lit(True) if low is None else F.col("seq") >= low) & (F.lit(True) if high is None else F.col("seq") < high)
        for low, high in zip(bounds, bounds[1:])
    ]


def build_mix(
    pairs: DataFrame,
    wi_quota: int = WI_QUOTA,
    wr_quota: int = WR_QUOTA,
    save_num: int = SAVE_NUM,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    tokens: str | None = None,
    report: Observation | None = None,
    seed: str = "",
) -> DataFrame:
    """Filter, remove near-duplicates, draw the mix, assemble and number."""
    survivors = clean_pool(pairs, threshold, num_perm, tokens, report)
    wi, wr = select_mix(survivors, wi_quota, wr_quota, seed)
    rows = min(wi_quota + wr_quota, save_num)
    numbered = number_mix(wi, wr, save_num)
    return assemble(pairs, numbered if rows <= MAX_BROADCAST_ROWS else materialize(numbered, "numbered"), rows, seed)
