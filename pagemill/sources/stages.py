"""Stage tables: one folder per stage, partitioned by category."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagemill.sources.answers import AnswerLog


@dataclass(frozen=True)
class StageStore:
    """Where the stage tables of one run live.

    ``<root>/<data>_<model>/<stage>``, with the categories of a stage as
    partition folders. Each stage has a folder of its own, as a job cannot
    overwrite the table it reads.
    """

    spark: SparkSession
    root: str
    data: str
    model: str

    def path(self, stage: str) -> str:
        return f"{self.root.rstrip('/')}/{self.data}_{self.model}/{stage}"

    def write(self, stage: str, df: DataFrame, wave: int = 0) -> None:
        """Write one wave, a disjoint part of the rows, of a stage."""
        # A partitioned table without rows has no file to take a schema from.
        if not self._exists(f"{self._schema_path(stage)}/_SUCCESS"):
            df.limit(0).write.mode("overwrite").parquet(self._schema_path(stage))
        writer = df.write.mode("overwrite")  # of an unfinished earlier attempt
        if "category" in df.columns:
            writer = writer.partitionBy("category")
        writer.parquet(self._wave_path(stage, wave))

    def read(self, stage: str) -> DataFrame:
        schema = self.spark.read.parquet(self._schema_path(stage)).schema
        return self.spark.read.schema(schema).parquet(self.path(stage))

    def finished(self, stage: str, wave: int = 0) -> bool:
        """Whether a wave was written to its end (its success marker is there)."""
        return self._exists(f"{self._wave_path(stage, wave)}/_SUCCESS")

    def answers(self, stage: str, wave: int = 0) -> AnswerLog:
        """The log of the answers of a wave that is not finished."""
        return AnswerLog(f"{self.path(stage)}.answers/wave={wave}")

    def _exists(self, path: str) -> bool:
        sc = self.spark.sparkContext
        file = sc._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(sc._jsc.hadoopConfiguration()).exists(file)

    def ensure(self, stage: str, build: Callable[[], DataFrame], wave: int = 0) -> None:
        """Write a wave, unless an earlier run has finished it."""
        if not self.finished(stage, wave):
            self.write(stage, build(), wave)

    def same_run(self, name: str, fields: Mapping[str, object]) -> None:
        """Keep what a run depends on, and refuse a store that another run has filled.

        The first call writes ``fields``; later ones raise if a field differs.
        """
        rows = [(key, str(value)) for key, value in sorted(fields.items())]
        self.ensure(name, lambda: self.spark.createDataFrame(rows, "field string, value string"))
        kept = {row["field"]: row["value"] for row in self.read(name).collect()}
        differing = sorted(key for key, value in rows if kept.get(key) != value)
        if differing or len(kept) != len(rows):
            raise ValueError(f"{self.path('')} belongs to a run with other {', '.join(differing) or 'fields'}")

    def _wave_path(self, stage: str, wave: int) -> str:
        return f"{self.path(stage)}/wave={wave}"

    def _schema_path(self, stage: str) -> str:
        return f"{self.path(stage)}.schema"


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "seq") -> DataFrame:
    """Write a catalog table bucketed and sorted by ``key``.

    Two tables with the same number of buckets join on ``key`` without a shuffle
    or a sort: the layout for pages and for stored completions that are attached
    to them again and again, where a shuffle would move all page text each time.
    """
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
