"""Session, table and scratch-space helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lattiq", cores: int | None = None, partitions: int | None = None, memory: str = "20g") -> SparkSession:
    """A session for local use and tests; on a cluster the submitted one is used as it is."""
    n = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all executors share.

    Only a local master may fall back to a folder of this machine; it is then set as
    the session's own checkpoint directory.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattiq-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lattiq-{spark.sparkContext.applicationId}"


#: Removes the shuffle files of an action at its end; Spark would keep them until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared scratch folder and read it back, which cuts its lineage.

    The rows survive lost executors, and the next plan starts from a scan with
    column pruning instead of repeating the work. Nothing reads the shuffles of the write
    again, so they go with it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` returned and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            if f"/lattiq-{spark.sparkContext.applicationId}/" in folder:
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove what :func:`materialize` has left for this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
