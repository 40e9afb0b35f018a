"""Structured Streaming: stateless map scoring of new rows, windowed counts, and running a stream over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattiq.operators.som import Codebook, assign


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def score_stream(rows: DataFrame, cb: Codebook, keep: list[str]) -> DataFrame:
    """Assign each new row to its neuron; the codebook travels inside the expression."""
    return assign(rows, cb, keep)


def windowed_counts(rows: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by kind, with rows later than the watermark left out."""
    w = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what is there, into Parquet beside the checkpoint; nothing passes through the driver.

    A batch that is repeated after a failure replaces its own files. In complete mode the
    last batch holds the whole result. With the checkpoint of an earlier call only new
    files are read, and the rows of all calls come back.
    """
    spark, path = df.sparkSession, f"{checkpoint}-rows"

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={no}")

    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(path if mode == "complete" else f"{path}/batch=-1")
    q = df.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
