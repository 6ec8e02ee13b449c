"""Reading and writing record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.sources.json_arrays import read_json_array, write_json_arrays  # noqa: F401

PAGES = T.StructType([T.StructField("webpage", T.StringType())])
MESSAGES = "array<struct<content: string, role: string>>"
FINAL_SCHEMA = f"prompt_id string, messages {MESSAGES}"


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """Records of a JSON file, or of a folder of them.

    A file whose root is an array gives a row per element, one whose root is an
    object gives one row; any other root fails the job. Such a file is parsed by
    one task: read large ones by ``read_json_array``, or write JSON Lines
    (``lines=True``), which split.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8")
    reader = reader.option("recursiveFileLookup", True)  # folders in it are no columns
    return reader.option("multiLine", not lines).json(path)


def read_json_in_order(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | str,
    lines: bool = False,
    split: bool = False,
) -> DataFrame:
    """Append files in the given order; ``source_ord`` and ``seq`` carry it.

    ``seq`` increases inside each file and is unique per path, not dense. Sort by
    ``(source_ord, seq)``. ``split`` reads each array file in several tasks.
    """
    merged: DataFrame | None = None
    for ordinal, path in enumerate(paths):
        if split:
            part = read_json_array(spark, path, schema, "seq").select(F.lit(ordinal).alias("source_ord"), "*")
        else:
            part = read_json(spark, path, schema, lines).select(
                F.lit(ordinal).alias("source_ord"), F.monotonically_increasing_id().alias("seq"), "*"
            )
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("no input path given")
    return merged


def union_pools(pools: Sequence[DataFrame]) -> DataFrame:
    """Append tables in the given order, with ``source_ord``."""
    merged: DataFrame | None = None
    for ordinal, pool in enumerate(pools):
        part = pool.withColumn("source_ord", F.lit(ordinal))
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("no pool given")
    return merged


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines: splittable, and readable by any JSON tool line by line."""
    df.write.json(path)


def write_parquet(df: DataFrame, path: str) -> int:
    """Write and return the number of rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]
