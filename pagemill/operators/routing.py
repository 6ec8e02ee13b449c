"""Category slices by row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.fixed_values import REQUEST_CATEGORIES
from pagemill.operators.numbering import position_cutoffs


def slice_bounds(rows: int) -> list[int]:
    """End positions of all slices but the last: two, two and one sixths of the
    rows; the last takes the remainder."""
    k = rows // 6
    return [2 * k, 4 * k, 5 * k]


def category_column(cutoffs: list[int | None], key: str = "seq") -> Column:
    """Category of a key, given the keys at the slice bounds."""
    chain = F
    for name, cutoff in zip(REQUEST_CATEGORIES, cutoffs):
        if cutoff is not None:
            chain = chain.when(F.col(key) < F.lit(cutoff), F.lit(name))
    last = F.lit(REQUEST_CATEGORIES[-1])
    return last if chain is F else chain.otherwise(last)


def route_categories(df: DataFrame, key: str = "seq") -> DataFrame:
    """Add ``category`` from the position of each row in key order.

    Slices are ranges of the key, so three key values decide them all and the
    routing itself is a projection: page text is neither sorted nor shuffled.
    """
    cutoffs = position_cutoffs(df.select(key), key, slice_bounds)
    return df.withColumn("category", category_column(cutoffs, key))
