"""Run results in a directory tree, read as one table with the keys that their paths name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lattiq.sources.tables import try_read

#: The tree's levels, as a pattern over a file's path: <dataset>/results/<run>/seed_<n>/<artefact>/<file>.
LEVELS = r"/([^/]+)/results/([^/]+)/seed_([0-9]+)/([^/]+)/[^/]+$"


def keys(path: Column) -> dict[str, Column]:
    """dataset, run, seed and artefact of a path."""
    names = ("dataset", "run", "seed", "artefact")
    found = {n: F.regexp_extract(path, LEVELS, k) for k, n in enumerate(names, 1)}
    return found | {"seed": F.when(found["seed"] != "", found["seed"]).cast("int")}


def files(spark: SparkSession, root: str) -> DataFrame:
    """dataset, run, seed, artefact, path, bytes and time of change of every result file; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    named = listed.select(*[c.alias(n) for n, c in keys(F.col("path")).items()], "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed_at"))
    return named.where("seed IS NOT NULL")


def read_artefact(spark: SparkSession, root: str, artefact: str, changed_after: str | None = None) -> DataFrame:
    """All rows of one kind of result below *root*, with dataset, run, seed and _source.

    Schemas are merged, so that runs of different versions read as one table. *changed_after*
    (a UTC time such as 2025-01-31T00:00:00) reads only files that are newer.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True)
    if changed_after is not None:
        reader = reader.option("modifiedAfter", changed_after).option("timeZone", "UTC")
    rows = reader.parquet(f"{root.rstrip('/')}/*/results/*/seed_*/{artefact}")
    own = keys(F.col("_metadata.file_path"))
    return rows.select("*", *[own[n].alias(n) for n in ("dataset", "run", "seed")], F.col("_metadata.file_path").alias("_source"))


def load_run(spark: SparkSession, root: str, dataset: str, run: str, seed: int, kinds: list[str]) -> dict[str, DataFrame | None]:
    """The stored tables of one run; None for those that it has not."""
    return {k: try_read(spark, f"{root.rstrip('/')}/{dataset}/results/{run}/seed_{seed}/{k}") for k in kinds}
