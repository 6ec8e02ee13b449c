"""Row filters and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import usable


def filter_special_pattern(df: DataFrame) -> DataFrame:
    """Keep rows with a request and a response that is no refusal."""
    return df.filter(usable(F.col("request"), F.col("response")))


def filter_report(df: DataFrame, by: str = "pool") -> DataFrame:
    dropped = F.when(usable(F.col("request"), F.col("response")), 0).otherwise(1)
    return df.groupBy(by).agg(F.count("*").alias("total"), F.sum(dropped).alias("deleted"))


def filter_counts(pools: tuple[str, ...] = ("WI", "WR")) -> list[Column]:
    """The report as metrics for ``DataFrame.observe``: counted while the rows
    pass on to their real use, and not by another scan of the texts."""
    kept = F.coalesce(usable(F.col("request"), F.col("response")), F.lit(False))
    counts = []
    for pool in pools:
        own = F.col("pool") == pool
        counts.append(F.count_if(own).alias(f"{pool}_total"))
        counts.append(F.count_if(own & ~kept).alias(f"{pool}_deleted"))
    return counts
