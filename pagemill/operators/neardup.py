"""Near-duplicate removal over banded MinHash.

The rule, for rows in list order: each row i looks up its candidates N(i), the
rows sharing at least one whole band with it (itself included), and all of N(i)
but the first is removed. Rows already removed look up too, so row r goes
exactly if some i in N(r) has min(N(i)) < r. That is four rounds of ``min`` over
the (row, bucket) table: bucket, row, bucket, row. No pair is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.fixed_values import NUM_PERM, THRESHOLD
from pagemill.operators.minhash import (
    band_hashes,
    band_shape,
    explode_bands,
    pair_of_hashes,
    signature,
    text_signature,
)
from pagemill.session import MAX_BROADCAST_ROWS, materialize

# Members of a bucket that one task may be given.
BUCKET_SPLIT = 200_000
BUCKET_KEY = ("k1", "k2")


def shared_buckets(
    table: DataFrame, idx: str, bucket: Sequence[str], split: int = BUCKET_SPLIT
) -> DataFrame:
    """Rows of the (row, bucket) table whose bucket has another member, with the
    bucket's least row ``lo`` and a shard number ``_shard`` of ``_shards``.

    Hot buckets are split: their rows spread over shards of about ``split``
    members, and the bucket's side of the join is repeated once per shard. The
    list of hot buckets is broadcast; it cannot exceed MAX_BROADCAST_ROWS, as
    ``split`` is raised to that fraction of all members.
    """
    bucket = list(bucket)
    members = (
        table.groupBy(*bucket).agg(F.count("*").alias("_members"), F.min(idx).alias("lo")).filter("_members > 1")
    )
    members = materialize(members, "buckets")
    total = members.agg(F.sum("_members")).first()[0] or 0
    split = max(split, -(-total // MAX_BROADCAST_ROWS))
    sizes = members.withColumn("_shards", F.ceil(F.col("_members") / split).cast("int")).drop("_members")
    hot = sizes.filter("_shards > 1").select(*bucket, "_shards")
    shards = F.coalesce("_shards", F.lit(1))
    sharded = (
        table.join(F.broadcast(hot), bucket, "left")
        .withColumn("_shard", F.pmod(F.xxhash64(idx), shards).cast("int"))
        .drop("_shards")
    )
    return sharded.join(_per_shard(sizes), [*bucket, "_shard"])


def _per_shard(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))


def least_candidate(table: DataFrame, idx: str, bucket: Sequence[str], split: int = BUCKET_SPLIT) -> DataFrame:
    """The index query of every row with a collision: ``first_candidate`` is the
    first row of its candidate set and ``shared`` the number of its shared
    buckets.

    One row per row: listing the candidate pairs themselves would be quadratic
    in the largest bucket, and removal needs only the first.
    """
    return (
        shared_buckets(table, idx, bucket, split)
        .groupBy(idx)
        .agg(F.min("lo").alias("first_candidate"), F.count("*").alias("shared"))
    )


def two_hop_removed(table: DataFrame, idx: str, bucket: Sequence[str], split: int = BUCKET_SPLIT) -> DataFrame:
    """The removed rows of a (row, bucket) table, as distinct ``idx``.

    ``idx`` must be unique per row and follow list order; the pool must be part
    of the bucket key where there is more than one. ``table`` is read twice.
    """
    bucket = list(bucket)
    edges = materialize(shared_buckets(table, idx, bucket, split), "edges")
    # A row is in one bucket per band, so this window holds a handful of rows.
    row_least = F.min("lo").over(Window.partitionBy(idx))
    by_bucket = (
        edges.withColumn("_m1", row_least)
        .groupBy(*bucket)
        .agg(F.min("_m1").alias("_m2"), F.max("_shards").alias("_shards"))
    )
    return (
        edges.drop("_shards")
        .join(_per_shard(by_bucket), [*bucket, "_shard"])
        .groupBy(idx)
        .agg(F.min("_m2").alias("_m3"))
        .filter(F.col("_m3") < F.col(idx))
        .select(idx)
    )


def collapse_equal_signatures(
    df: DataFrame,
    tokens: Column | None = None,
    carry: Sequence[str] = (),
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
) -> DataFrame:
    """First row of each (pool, signature), with its band keys in ``_bands``.

    Rows of equal signature share every band, so all but the first of them are
    removed whatever else happens, and their looking up adds nothing that the
    first does not. A third of all rows being copies of one text thus shrinks to
    one row in the map-side aggregation, before any bucket is built. Band keys are
    single numbers there, so that it stays hash-based unless ``carry`` has columns
    of variable width.
    """
    bands, rows = band_shape(threshold, num_perm)
    signed = text_signature(F.col("request"), num_perm) if tokens is None else signature(tokens, num_perm)
    signed = df.select("pool", "seq", *carry, signed.alias("_sig"))
    keyed = signed.select(
        "pool",
        "seq",
        *carry,
        pair_of_hashes(F.col("pool"), F.col("_sig")).alias("_key"),
        band_hashes(F.col("pool"), F.col("_sig"), bands, rows).alias("_bands"),
    )
    return (
        keyed.groupBy("pool", F.col("_key")[0].alias("_s1"), F.col("_key")[1].alias("_s2"))
        .agg(
            F.min("seq").alias("seq"),
            *[F.min_by(c, "seq").alias(c) for c in carry],
            *[F.first(F.get("_bands", F.lit(k))).alias(f"_b{k}") for k in range(2 * bands)],
        )
        .select("pool", "seq", *carry, F.array(*[f"_b{k}" for k in range(2 * bands)]).alias("_bands"))
    )


def surviving_rows(
    df: DataFrame,
    tokens: Column | None = None,
    carry: Sequence[str] = (),
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    split: int = BUCKET_SPLIT,
) -> DataFrame:
    """``(pool, seq, *carry)`` of the rows left by near-duplicate removal.

    ``seq`` must be unique over all pools. Pools are handled in one pass and
    never compared. Only narrow rows are shuffled: carry a page hash, not text.
    What is compared is ``request``, or the column of token lists ``tokens``.
    """
    bands, _ = band_shape(threshold, num_perm)
    firsts = materialize(collapse_equal_signatures(df, tokens, carry, threshold, num_perm), "signatures")
    table = explode_bands(firsts.select("seq", "_bands"), "_bands", bands)
    removed = two_hop_removed(table, "seq", BUCKET_KEY, split)
    return firsts.drop("_bands").join(removed, "seq", "left_anti")


def drop_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """Whole rows of ``df`` that survive. Joins the text by ``seq``; work that
    needs few rows in the end should go on from ``surviving_rows`` instead."""
    return df.join(surviving_rows(df, **options).select("seq"), "seq", "left_semi")


def dedup_report(before: DataFrame, after: DataFrame, by: str = "pool") -> DataFrame:
    """Removed rows and the percentage kept; null for an empty pool."""
    total = before.groupBy(by).agg(F.count("*").alias("total"))
    kept = after.groupBy(by).agg(F.count("*").alias("kept"))
    kept_rows = F.coalesce("kept", F.lit(0))
    ratio = F.when(F.col("total") > 0, F.round(kept_rows / F.col("total") * 100, 2))
    return total.join(kept, by, "left").select(
        by, (F.col("total") - kept_rows).alias("deleted"), ratio.alias("remain_percent")
    )
