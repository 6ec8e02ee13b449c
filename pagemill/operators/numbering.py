"""Row positions without a one-partition window.

Three forms, from cheap to general:

* ``position_cutoffs`` finds the key values that sit at given positions, by
  counting; no row is shuffled. Use it where position only decides a slice.
* ``first_by_draw`` takes and numbers the first rows in drawn order. A uniform
  draw splits evenly by its leading bits, so bucket counts give the offsets.
* ``global_row_number`` numbers every row in any total order, by a range sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.draws import DRAW_BITS, draw_u32
from pagemill.session import MAX_BROADCAST_ROWS, materialize

FAN_OUT = 4096
PREFIX_BITS = 16


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``.

    ``order`` must be a total order (end it with a unique column): the range
    sort then splits evenly, however often a leading value repeats.
    """
    ids = F.monotonically_increasing_id()
    ordered = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", ids)
        .withColumn("_part", F.shiftright("_id", 33)),
        "ordered",
    )
    # One row per partition of the sort: a bounded table to run a window over.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part")
        .agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
        .select("_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    position = F.col("_offset") + F.col("_id") - F.col("_first")
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, position)
        .drop("_id", "_part", "_first", "_offset")
    )


def position_cutoffs(
    df: DataFrame, key: str, positions: Callable[[int], Sequence[int]]
) -> list[int | None]:
    """For each of the 0-based ``positions(row count)``, the unique BIGINT ``key``
    at it (None past the end).

    Counts keys in at most FAN_OUT equal ranges and looks again inside the range
    that holds the position: at most six passes for 64-bit keys of any
    distribution, usually two, of which the first serves all positions. A pass
    reads the key column and returns counts.
    """
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(key)).first()

    @cache
    def counted(lo: int, hi: int) -> tuple[int, list[tuple[int, int]]]:
        """Width of the ranges, and (range, rows) in order: FAN_OUT + 1 at most."""
        width = -(-(hi - lo + 1) // FAN_OUT)
        # Floor division that cannot overflow: ranges start at multiples of the width.
        bucket = F.expr(f"{key} div {width} - int({key} % {width} < 0)").alias("bucket")
        counts = df.filter(F.col(key).between(lo, hi)).groupBy(bucket).agg(F.count("*").alias("rows"))
        return width, sorted((r.bucket, r.rows) for r in counts.collect())

    def key_at(position: int) -> int | None:
        if not 0 <= position < rows:
            return None
        lo, hi, rest = low, high, position
        while lo < hi:
            width, counts = counted(lo, hi)
            for bucket, held in counts:
                if rest < held:
                    lo, hi = max(lo, bucket * width), min(hi, (bucket + 1) * width - 1)
                    break
                rest -= held
        return lo

    return [key_at(position) for position in positions(rows)]


def first_by_draw(
    df: DataFrame, salt: str, key: str, quota: int | Column, name: str = "position"
) -> DataFrame:
    """The first ``quota`` rows in the order of a keyed draw, with 0-based positions.

    Same rows as ``orderBy(draw, key).limit(quota)``, but no task sees more than
    the rows of one draw prefix (about 1 in 65,536), and prefixes beyond the
    quota are dropped before the shuffle. ``df`` is read twice: pass a table.
    """
    quota = quota if isinstance(quota, Column) else F.lit(quota)
    drawn = df.withColumn("_draw", draw_u32(salt, F.col(key))).withColumn(
        "_prefix", F.shiftright("_draw", DRAW_BITS - PREFIX_BITS)
    )
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        drawn.groupBy("_prefix")
        .agg(F.count("*").alias("_rows"))
        .select("_prefix", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
        .filter(F.col("_offset") < quota)
    )
    inside = Window.partitionBy("_prefix").orderBy("_draw", key)
    return (
        drawn.join(F.broadcast(offsets), "_prefix")  # at most 2^16 rows of two numbers
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .filter(F.col(name) < quota)
        .drop("_draw", "_prefix", "_offset")
    )


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if ``rows``, an upper bound of its size, allows."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df
