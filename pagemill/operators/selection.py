"""Quotas without page overlap."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.draws import DRAW_BITS, draw_u32
from pagemill.operators.numbering import first_by_draw
from pagemill.session import MAX_BROADCAST_ROWS, materialize


def page_key(webpage: Column) -> Column:
    """32 bytes that stand for a page in every shuffle."""
    return F.unhex(F.sha2(webpage, 256))


PAGE_NUMBERS = ("page0", "page1", "page2", "page3")


def page_numbers(webpage: Column) -> list[Column]:
    """The 32 bytes as four BIGINT, which aggregations can carry without sorting."""
    digits = F.sha2(webpage, 256)
    return [
        F.conv(F.substring(digits, 16 * k + 1, 16), 16, -10).cast("bigint").alias(name)
        for k, name in enumerate(PAGE_NUMBERS)
    ]


def page_of_numbers() -> Column:
    """The 32 bytes again."""
    return F.unhex(F.concat(*[F.lpad(F.hex(name), 16, "0") for name in PAGE_NUMBERS]))


def quota_sample(df: DataFrame, salt: str, quota: int, key: str = "seq", name: str = "position") -> DataFrame:
    """Shuffle and take the first ``quota`` rows."""
    return first_by_draw(df, salt, key, quota, name)


def distinct_pages(df: DataFrame) -> DataFrame:
    return df.select("page").distinct()


def first_per_page(df: DataFrame, salt: str, key: str = "seq") -> DataFrame:
    """The row of each page that comes first in shuffled order: ``(page, key)``.

    A ``min`` with map-side combine and not a window, so that a page holding a
    third of all rows is one row per task before the shuffle. Draw and key are the
    digits of one DECIMAL, exact for every BIGINT key, so that it stays hash-based.
    """
    base, shift = F.lit(Decimal(1 << 64)), F.lit(Decimal(1 << 63))
    digits = F.col(key).cast("decimal(20,0)") + shift
    rank = (draw_u32(salt, F.col(key)).cast("decimal(10,0)") * base + digits).cast("decimal(38,0)")
    least = F.col("_first") % base - shift
    return (
        df.groupBy("page")
        .agg(F.min(rank).alias("_first"))
        .select("page", least.cast(df.schema[key].dataType).alias(key))
    )


# Bits of the map of used pages, in cells of 2^15; and bits for each used page that let about one
# unused page in sixteen be looked at.
MAP_BITS = 1 << 28
CELL_BITS = 1 << 15
BITS_PER_PAGE = 16


def _map_place(bits: int) -> tuple[Column, Column]:
    """Cell, from 0, and bit in it of a page."""
    place = F.pmod(F.xxhash64("page"), F.lit(bits))
    return F.shiftright(place, 15), (place % CELL_BITS).cast("int")


def pages_met(df: DataFrame, used: DataFrame, used_rows: int, most_bits: int = MAP_BITS) -> DataFrame:
    """``df`` with ``_met``: false where the page is certainly not in ``used``.

    Every used page sets one bit, by its hash, of a map of at most ``most_bits`` (32 MB), which is
    broadcast whatever the number of pages. Cells are made with map-side combine.
    """
    bits = CELL_BITS
    while bits < min(most_bits, BITS_PER_PAGE * used_rows):
        bits *= 2
    cell, bit = _map_place(bits)
    cells = used.groupBy(cell.alias("_cell")).agg(F.bitmap_construct_agg(bit.cast("bigint")).alias("_map"))
    looked_up = df.withColumns({"_cell": cell, "_bit": bit})
    byte = F.conv(F.hex(F.expr("substring(_map, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    met = F.expr("shiftright(_byte, _bit % 8) & 1") == 1
    joined = looked_up.join(F.broadcast(cells), "_cell", "left").withColumn("_byte", byte)
    return joined.withColumn("_met", F.coalesce(met, F.lit(False))).drop("_cell", "_bit", "_map", "_byte")


def unused_pages(df: DataFrame, used: DataFrame, used_rows: int, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows whose page is not in ``used``, a table of at most ``used_rows``
    distinct pages. Call it on one row per page, so that no page is hot.

    Up to ``most`` used pages are broadcast. More are looked up in a broadcast bit map first:
    rows whose bit is not set are done, and only the others are shuffled to be compared.
    Both sides are read twice then: pass tables.
    """
    if used_rows <= most:
        return df.join(F.broadcast(used), "page", "left_anti")
    marked = pages_met(df, used, used_rows)
    free = marked.filter(~F.col("_met")).drop("_met")
    compared = marked.filter("_met").drop("_met").join(used, "page", "left_anti")
    return free.unionByName(compared.select(*free.columns))


# Rows below the first guess of the draw, for each row of the quota.
FIRST_GUESS = 1.25


def select_unused(wr: DataFrame, used: DataFrame, used_rows: int, salt: str, quota: int) -> DataFrame:
    """The first ``quota`` pages of ``wr (seq, page)`` in drawn order that are not in ``used``,
    by their first rows: ``page, seq, position``.

    As when a scan in drawn order stops at the quota, rows behind it are not looked at: only rows
    whose draw is below a bound are grouped by page and compared, and the bound is raised until they
    are enough. The first row of a page is below the bound if any is, so the result is that of all rows.
    """
    rows = wr.count()
    bound = 1 << DRAW_BITS
    guess = min(bound, int(bound * min(1.0, FIRST_GUESS * quota / max(1, rows))) + 1)
    while True:
        below = wr.filter(draw_u32(salt, F.col("seq")) < guess) if guess < bound else wr
        firsts = materialize(first_per_page(below, salt), "wr_firsts")
        found = materialize(unused_pages(firsts, used, used_rows), "wr_candidates")
        count = found.count()
        if count >= quota or guess >= bound:
            return quota_sample(found, salt, quota)
        # By the share of the bound that was enough for those found, and some more.
        guess = min(bound, int(guess * max(2.0, FIRST_GUESS * quota / max(1, count))))


def select_mix(
    survivors: DataFrame, wi_quota: int, wr_quota: int, seed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """WI rows and WR rows of the final mix, as ``(seq, page, position)`` each.

    ``survivors`` holds ``(pool, seq, page)``. Scanning shuffled WR rows and
    taking each whose page is new until the quota is full gives the same rows as
    this: first row per page, minus WI pages, first ``wr_quota`` in the order.
    """
    wi = quota_sample(survivors.filter("pool = 'WI'").drop("pool"), f"{seed}shuffle_wi", wi_quota)
    wi = materialize(wi, "wi_rows")
    used = distinct_pages(wi)
    if wi_quota > MAX_BROADCAST_ROWS:
        used = materialize(used, "wi_pages")
    wr = select_unused(survivors.filter("pool = 'WR'").drop("pool"), used, wi_quota, f"{seed}shuffle_wr", wr_quota)
    return wi, wr.select("seq", "page", "position")
