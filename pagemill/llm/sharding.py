"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key: a hash of the text, then a hash of the id. Between two
shards lies a splitter, a key with a wanted number of bytes below it. Candidate
boundaries are counted exactly over all partitions, beginning with 4,096 that
divide the key space; where the wanted number falls between two of them by more than
the tolerance, that interval is divided again. What is counted is two hashes and a
size per row; what is collected is at most a few hundred sums per splitter and
round. Rows are exchanged once, when all splitters stand.

Equal texts share the first part of the key, so they lie in one shard unless a
boundary falls into a group of more than twice the tolerance: then, and only then,
the second part of the key cuts the group. A third of all rows may be one text.

Null texts weigh nothing but the row's overhead, empty ones the same. Rows that
repeat in id and text have one key and stay together, and their slots are dealt in any
order. An empty table gives an empty result. All columns of the input are
passed on; names that the result adds (``shard``, ``slot``) are refused.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pagemill.session import materialize

# Bits of each part of the key, and how many are told apart in each round.
PART_BITS = 60
ROUNDS = (12, 8, 8, 8, 8, 8, 8)
# Rows of a shard that are numbered in one sort.
SLOT_GROUP = 20_000


def shard_key(text: Column, row_id: Column) -> tuple[Column, Column]:
    """Two numbers of ``PART_BITS`` bits each."""
    shift = 64 - PART_BITS
    return F.shiftrightunsigned(F.xxhash64(text), shift), F.shiftrightunsigned(F.xxhash64(row_id, text), shift)


@dataclass
class _Probe:
    """A splitter in the making: the interval that holds it and the bytes below that."""

    target: float
    prefix: int = 0
    below: int = 0
    key: int | None = None


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """``shards - 1`` keys such that the bytes below the i-th are within ``tolerance`` of
    the mean shard from i shards, or as near as whole rows allow.

    ``keys`` has the columns ``k1``, ``k2`` and ``size``.
    """
    probes: list[_Probe] = []
    total_bits = 2 * PART_BITS
    used = 0
    for bits in ROUNDS * 2:
        active = [p for p in probes if p.key is None]
        if used and not active:
            break
        column, at = ("k1", used) if used < PART_BITS else ("k2", used - PART_BITS)
        rest = PART_BITS - at - bits
        wanted = {p.prefix for p in active}
        rows = keys
        if used >= PART_BITS:
            rows = rows.where(F.col("k1").isin([x >> at for x in wanted]))
        if at:
            mask = (1 << at) - 1
            rows = rows.where(F.shiftright(column, PART_BITS - at).isin([x & mask for x in wanted]))
        first = F.col("k1") if used >= PART_BITS else F.lit(0)
        grouped = rows.groupBy(first.alias("first"), F.shiftright(column, rest).alias("bin"))
        # At most 2^bits rows for each splitter.
        counts = grouped.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        bins: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for row in sorted(counts, key=lambda r: (r["first"], r["bin"])):
            whole = (row["first"] << at + bits | row["bin"]) if used >= PART_BITS else row["bin"]
            bins[whole >> bits].append((whole, row["bytes"], row["rows"]))
        if not used:
            total = sum(size for _, size, _ in bins[0])
            if not total:
                return []
            probes = active = [_Probe(total * i / shards) for i in range(1, shards)]
            allowed = tolerance * total / shards
        used += bits
        for probe in active:
            below = probe.below
            for whole, size, count in bins[probe.prefix]:
                if below + size < probe.target:
                    below += size
                    continue
                low, high = probe.target - below, below + size - probe.target
                if min(low, high) <= allowed or count == 1 or used == total_bits:
                    probe.key = (whole if low <= high else whole + 1) << total_bits - used
                else:
                    probe.prefix, probe.below = whole, below
                break
    return [(p.key >> PART_BITS, p.key & (1 << PART_BITS) - 1) for p in probes]


def shard_of(k1: Column, k2: Column, splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters that are not above the key."""
    if not splitters:
        return F.lit(0)
    bounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in splitters])
    return F.size(F.filter(bounds, lambda s: (s["a"] < k1) | ((s["a"] == k1) & (s["b"] <= k2))))


def shard_documents(
    docs: DataFrame,
    shards: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    overhead: int = 16,
    tolerance: float = 0.005,
) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and overhead), ``shard`` from 0 and ``slot``,
    gapless from 0 within the shard."""
    if clash := {"size", "shard", "slot", "k1", "k2", "slot_group", "slots_before"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    k1, k2 = shard_key(F.col(text_column), F.col(id_column))
    size = (F.coalesce(F.octet_length(text_column), F.lit(0)) + overhead).cast("long")
    keyed = docs.withColumns({"size": size, "k1": k1, "k2": k2})
    keys = materialize(keyed.select("k1", "k2", "size"), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)

    # A shard's rows are numbered in groups, each moved by the rows of the groups before it.
    def grouped(df: DataFrame, groups: int) -> DataFrame:
        shard = shard_of(F.col("k1"), F.col("k2"), splitters).cast("int")
        return df.withColumns({"shard": shard, "slot_group": F.pmod(F.xxhash64("k2"), F.lit(groups)).cast("int")})

    largest = grouped(keys, 1).groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 0
    groups = max(1, largest // SLOT_GROUP)
    sizes = grouped(keys, groups).groupBy("shard", "slot_group").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("shard").orderBy("slot_group").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "shard", "slot_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slots_before")
    )
    inside = W.Window.partitionBy("shard", "slot_group").orderBy("k1", "k2")
    numbered = grouped(keyed, groups).withColumn("slot", F.row_number().over(inside).cast("long") - 1)
    placed = numbered.join(offsets, ["shard", "slot_group"]).withColumn("slot", F.col("slot") + F.col("slots_before"))
    return placed.select(*[placed[c] for c in docs.columns], "size", "shard", "slot")
