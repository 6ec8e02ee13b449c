"""A near-duplicate index that lasts: pools that come later are looked up in it and added to it.

What is kept is, for every bucket of every insertion, its least row and the number of its
rows, in files bucketed by the band key. So a hot bucket is one row for each insertion, rows that
are in the index are never signed again, and the index is never shuffled: only the rows
that are looked up are brought to its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.neardup import BUCKET_KEY

COLUMNS = ("k1", "k2", "lo", "members")


class BandIndex:
    """The index below ``path``, as a catalog table of that name.

    ``buckets`` is fixed when the folder is first written: choose it for 128 to 256 MB a bucket
    at the size that the index will have. A session that knows nothing of the table registers the folder again.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 64):
        self.spark, self.table = spark, table
        location = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (k1 BIGINT, k2 BIGINT, lo BIGINT, members BIGINT) USING parquet "
            f"CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def insert(self, bands: DataFrame, idx: str = "seq") -> None:
        """Add the rows of a (row, bucket) table, each row once: ``idx`` and ``k1, k2``.

        Summed with map-side combine, so that a bucket of a third of all rows is one row
        per task. Written in one commit: an insertion that fails adds nothing.
        """
        summed = bands.groupBy(*BUCKET_KEY).agg(F.min(idx).cast("bigint").alias("lo"), F.count("*").alias("members"))
        summed.select(*COLUMNS).write.insertInto(self.table)

    def candidates(self, bands: DataFrame, idx: str = "seq") -> DataFrame:
        """For rows that are in the index: ``first_candidate``, the first row of all that
        share a bucket with it, itself included, and the number of its ``shared`` buckets.

        Rows that share none are left out, as in ``least_candidate`` over all rows at once.
        """
        least = self.spark.table(self.table).groupBy(*BUCKET_KEY)
        least = least.agg(F.min("lo").alias("lo"), F.sum("members").alias("members")).filter("members > 1")
        met = bands.select(idx, *BUCKET_KEY).join(least.hint("merge"), list(BUCKET_KEY))
        return met.groupBy(idx).agg(F.min("lo").alias("first_candidate"), F.count("*").alias("shared"))

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
