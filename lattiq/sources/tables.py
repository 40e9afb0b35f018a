"""Readers of user files, with the checks that an analysis needs."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattiq.operators.profile import validate_input


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", selected: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A CSV table: trimmed after delimiters, blank and all-null rows dropped, empty is an error."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("ignoreLeadingWhiteSpace", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    nan = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    return validate_input(df.withColumns(nan).dropna("all"), selected)


def try_read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The table, or None where nothing is stored at *path*."""
    try:
        return spark.read.format(kind).option("header", True).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON document, read through Spark so that any store works; malformed text is a ValueError."""
    text = spark.read.text(path, wholetext=True).first()
    try:
        found = json.loads(text[0]) if text else None
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: {e}") from None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by name with a _source column; columns may differ."""
    out: DataFrame | None = None
    for name, df in frames.items():
        df = df.withColumn("_source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """All result tables that match a glob, with the file each row is from."""
    return spark.read.option("header", True).csv(pattern).withColumn("_source", F.col("_metadata.file_path"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """name, size and kind of the PNG files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.startswith("u_matrix"), "u_matrix").when(name.startswith("component_"), "component").when(name.startswith("pie_"), "pie").when(name.startswith("hit_"), "hit").otherwise("other")
    return files.select(name.alias("name"), F.col("length").alias("bytes"), kind.alias("kind"))
