"""The store of runs: eleven tables, queried and updated as DataFrames.

Updates return the new table; the caller writes it. Keys are checked, as Parquet has no
constraints, and the errors of the queries are Python exceptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class NotFoundError(LookupError):
    """A key that should be there is not."""


class ConflictError(ValueError):
    """A key that should be new is there."""


class InvalidRequestError(ValueError):
    """A parameter is out of its range."""


SORT_KEYS = {"neuron_key": False, "sample_count": True, "qe_mean": True, "qe_max": True}


def one(df: DataFrame, col: str, value) -> DataFrame:
    found = df.where(F.col(col) == F.lit(value))
    if found.isEmpty():
        raise NotFoundError(f"{col} {value!r}")
    return found


def listing(df: DataFrame, col: str, newest_first: bool = False) -> DataFrame:
    return df.orderBy(F.desc(col) if newest_first else F.asc(col))


def insert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append rows with new keys."""
    if not rows.join(df, key, "left_semi").isEmpty():
        raise ConflictError(f"{key} exists")
    return df.unionByName(rows, allowMissingColumns=True)


def insert_missing(df: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with the rows whose keys are new, one row of inserted and skipped counts)."""
    new = rows.join(df.select(*keys), keys, "left_anti")
    counts = rows.agg(F.count(F.lit(1)).alias("all")).join(F.broadcast(new.agg(F.count(F.lit(1)).alias("inserted"))))  # one row each
    return df.unionByName(new, allowMissingColumns=True), counts.select("inserted", (F.col("all") - F.col("inserted")).alias("skipped"))


def update(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Replace the non-null fields of matching rows."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return df.join(renamed, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*[f"_{c}" for c in fields]).select(*df.columns)


def delete_cascade(tables: dict[str, DataFrame], owner: str, key: str, value, child_key: str) -> dict[str, DataFrame]:
    """All tables without the owner's row and the rows that name it."""
    one(tables[owner], key, value)
    return {n: t.where(~F.col(key if n == owner else child_key).eqNullSafe(F.lit(value))) if n == owner or child_key in t.columns else t for n, t in tables.items()}


def compare_runs(runs: DataFrame, ids: list[str]) -> DataFrame:
    wanted = list(dict.fromkeys(i.strip() for i in ids if i.strip()))
    if len(wanted) < 2:
        raise InvalidRequestError("two runs at least")
    found = runs.where(F.col("id").isin(wanted))
    missing = set(wanted) - {r["id"] for r in found.select("id").collect()}
    if missing:
        raise NotFoundError(f"runs {sorted(missing)}")
    return found


def neuron_qe(assignments: DataFrame) -> DataFrame:
    """Mean, maximum and count of the known errors of each neuron of each run."""
    known = assignments.where("qe IS NOT NULL")
    return known.groupBy("run_id", F.col("bmu_key").alias("neuron_key")).agg(F.round(F.avg("qe"), 6).alias("qe_mean"), F.max("qe").alias("qe_max"), F.count(F.lit(1)).alias("sample_count"))


def replace_clusters(clusters: DataFrame, new: DataFrame) -> DataFrame:
    """Bulk upload: rows of the same run and neuron are replaced."""
    return clusters.join(new.select("run_id", "neuron_key"), ["run_id", "neuron_key"], "left_anti").unionByName(new)


def append_to_run(df: DataFrame, rows: DataFrame, runs: DataFrame, run_id) -> DataFrame:
    """Bulk upload of assignments or anomalies: rows are added under the run, which must exist; those there stay as they are."""
    one(runs, "id", run_id)
    return df.unionByName(rows.withColumn("run_id", F.lit(run_id).cast(df.schema["run_id"].dataType)), allowMissingColumns=True)


def list_clusters(clusters: DataFrame, errors: DataFrame, run_id, sort_by: str = "neuron_key", top: int = 0) -> DataFrame:
    """Clusters of a run with their errors; *top* 0 gives all."""
    if sort_by not in SORT_KEYS or top < 0:
        raise InvalidRequestError(f"sort_by {sort_by!r}, top {top}")
    x = clusters.where(F.col("run_id") == F.lit(run_id)).join(errors.drop("sample_count"), ["run_id", "neuron_key"], "left")
    order = [F.desc(F.coalesce(F.col(sort_by), F.lit(0)))] if SORT_KEYS[sort_by] else []
    x = x.orderBy(*order, "neuron_key")
    return x.limit(top) if top else x


def list_anomalies(anomalies: DataFrame, run_id, limit: int = 0) -> DataFrame:
    """Anomalies of a run by descending error, unknown ones last."""
    if limit < 0:
        raise InvalidRequestError(f"limit {limit}")
    x = anomalies.where(F.col("run_id") == F.lit(run_id)).orderBy(F.col("qe").desc_nulls_last(), "sample_id")
    return x.limit(limit) if limit else x


def run_summary(runs: DataFrame, clusters: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per run: active and dead neurons, anomalies."""
    active = clusters.groupBy(F.col("run_id").alias("id")).agg(F.count_distinct("neuron_key").alias("active"))
    odd = anomalies.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("anomalies"))
    x = runs.join(active, "id", "left").join(odd, "id", "left").fillna(0, ["active", "anomalies"])
    return x.withColumn("dead", F.greatest(F.lit(0), F.col("map_m") * F.col("map_n") - F.col("active")))


def health(tables: dict[str, DataFrame], expected: int = 11) -> dict:
    """ok if all expected tables are there and hold a row; each is opened and read for it."""
    filled = sum(not t.isEmpty() for t in tables.values())
    return {"status": "ok" if len(tables) == filled == expected else "degraded", "tables": len(tables)}
