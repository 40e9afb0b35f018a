"""Writers of run artefacts: one Parquet table per kind, partitioned by run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

KINDS = ("codebook", "checkpoints", "coverage", "metrics", "column_info", "normalized", "assignments", "neuron_qe", "clusters", "anomalies")


def append_run(df: DataFrame, root: str, kind: str, run_id: str) -> None:
    """Append the rows of one run; tables without rows are not written."""
    if kind not in KINDS:
        raise ValueError(f"unknown artefact {kind!r}")
    if not df.isEmpty():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{root}/{kind}")


def overwrite_run(df: DataFrame, root: str, kind: str, run_id: str) -> None:
    """Replace one run's rows and leave the other runs."""
    df.write.mode("overwrite").parquet(f"{root}/{kind}/run_id={run_id}")


def to_csv(df: DataFrame, path: str, order_by: list[str]) -> None:
    """A sorted CSV with a header, one file per output partition."""
    df.orderBy(*order_by).write.mode("overwrite").option("header", True).csv(path)


def to_json_documents(df: DataFrame, key: str) -> DataFrame:
    """(key, document): each row as JSON, for text sinks."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("document"))


def write_files(rows: DataFrame, root: str, path: str = "path", value: str = "value") -> int:
    """Write each row's text to the file that it names below *root*; the number of files written.

    The tasks write and rename their files themselves, so no committer moves them one by one
    and many may share a folder. A file appears whole under its name; a task that runs again
    replaces it by the same. *root* may be on any file system that pyarrow knows.
    """
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, file = f"{base}/{name}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                hidden = f"{folder}/.{file}.{attempt}"
                with system.open_output_stream(hidden) as out:
                    out.write(text.encode())
                system.move(hidden, f"{folder}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select(F.col(path).alias("path"), F.col(value).alias("value")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
