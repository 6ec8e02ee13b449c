"""Session helpers: a local session builder, shared scratch space, stage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows a broadcast side may hold. Every broadcast in the package is of narrow
# rows (ids, offsets, 32-byte hashes), so this is well under 200 MB.
MAX_BROADCAST_ROWS = 1_000_000

# Whether Spark deletes a query's shuffle files when it ends, and not when the driver's
# garbage collector finds them unused.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", app: str = "pagemill", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to the warehouse folder: on a cluster that may
    be local to the driver, so an unset folder is an error there.
    """
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_folder(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/pagemill/{sc.applicationId}"


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, once nothing reads them any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application.

    For the end of a job, after its last result is written: results that are read
    later, and jobs that still run in this session, need their tables.
    """
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in shared scratch space and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a
    recomputation, and gives the next plan real file sizes to choose joins by. The
    shuffle files of the write, of use to nothing later, go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table
