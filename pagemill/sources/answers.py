"""Model answers kept as they come, so that a lost task does not send its prompts again."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = pa.schema([("prompt_hash", pa.string()), ("answer", pa.string()), ("attempt", pa.int32())])


@dataclass(frozen=True)
class AnswerLog:
    """Answers below a folder of storage that all executors share, keyed by the SHA-256 of the
    prompt.

    Tasks only add files, one for each call of the backend, in a folder for their partition. A retry of a task
    reads the folder of its partition; a job that is started again joins the whole log.
    Files are renamed into place, so none is read half written. Tasks write through
    ``pyarrow.fs``: a mounted folder, or a store that it knows (S3, GCS, HDFS).
    """

    path: str

    def _place(self) -> tuple[fs.FileSystem, str]:
        path = self.path
        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
        if path.startswith("s3a://"):
            path = "s3" + path.removeprefix("s3a")
        return fs.FileSystem.from_uri(path)

    def add(self, partition: int, rows: Sequence[tuple[str, str, int]]) -> None:
        """Keep (prompt hash, answer, attempt) of a call."""
        if not rows:
            return
        store, root = self._place()
        folder = f"{root}/part={partition}"
        store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)
        with store.open_output_stream(f"{folder}/_{name}") as out:
            pq.write_table(table, out)
        store.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")

    def of_partition(self, partition: int) -> dict[str, tuple[str, int]]:
        """Answers that an earlier attempt of a task has got, by prompt hash."""
        store, root = self._place()
        listed = store.get_file_info(fs.FileSelector(f"{root}/part={partition}", allow_not_found=True))
        known = {}
        for info in sorted(listed, key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as file:
                    columns = pq.read_table(file, schema=SCHEMA).to_pydict()
                known |= {h: (a, n) for h, a, n in zip(*(columns[name] for name in SCHEMA.names))}
        return known

    def table(self, spark: SparkSession) -> DataFrame | None:
        """``prompt_hash, answer, attempt``, one row per prompt; None if there is no answer."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(
            spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part=*/*.parquet")
        )
        if not files:
            return None
        kept = spark.read.schema("prompt_hash string, answer string, attempt int").parquet(self.path)
        first = kept.groupBy("prompt_hash").agg(F.min(F.struct("attempt", "answer")).alias("kept"))
        return first.select("prompt_hash", "kept.answer", "kept.attempt")

    def clear(self, spark: SparkSession) -> None:
        """Delete the log, once its answers are part of a written table."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
