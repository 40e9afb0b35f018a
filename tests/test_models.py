"""Archives, shuffles and run trees at their edges."""

import time
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lattiq.operators import archive, importance
from lattiq.sources import catalogue


def test_archive_retires_and_remembers(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0, 0.0, 0), ("b", 5.0, 1.0, 0.0, 0), ("c", 6.0, 6.0, 0.0, 0), ("d", 0.5, 0.5, 0.0, 1), ("a", 0.0, 0.0, 0.0, 1), ("e", 0.0, 0.0, 2.0, 2), ("f", 0.5, 0.5, 0.0, 2)], "uid string, x double, y double, cv double, g int")
    got = {r.uid: (r.entered, r.retired) for r in archive.evolve_archive(rows, "g", "uid", ["x", "y"], "cv").collect()}
    # a known uid is no newcomer, an equal point is not dominated, an infeasible one never gets in
    assert got == {"a": (0, 1), "b": (0, 1), "d": (1, None), "f": (2, None)}
    assert archive.evolve_archive(rows.where("false"), "g", "uid", ["x", "y"], "cv").count() == 0


def test_a_column_that_is_not_used_has_no_importance(spark):
    rows = spark.range(500).select("id", (F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 11).cast("double").alias("y"))
    got = {r.feature: r for r in importance.permutation_importance(rows, "id", ["a", "b"], "y", lambda x: x["a"], repeats=2).collect()}
    assert got["b"].importance == 0 and got["a"].baseline == 0
    assert 15 < got["a"].importance < 25  # twice the variance of 0..10
    assert importance.permutation_importance(rows.where("false"), "id", ["a", "b"], "y", lambda x: x["a"]).count() == 0


def test_only_newer_files_are_read_again(spark, tmp_path):
    root = str(tmp_path)
    one = spark.range(3).select(F.col("id").alias("uid"))
    one.write.parquet(f"{root}/d/results/r1/seed_1/results")
    time.sleep(1.1)
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    time.sleep(1.1)
    one.withColumn("extra", F.lit(1)).write.parquet(f"{root}/d/results/r2/seed_7/results")
    assert sorted((r.run, r.seed, r.uid, r.extra) for r in catalogue.read_artefact(spark, root, "results").collect()) == [("r1", 1, k, None) for k in range(3)] + [("r2", 7, k, 1) for k in range(3)]
    assert {(r.run, r.seed) for r in catalogue.read_artefact(spark, root, "results", now).collect()} == {("r2", 7)}
    loaded = catalogue.load_run(spark, root, "d", "r2", 7, ["results", "metrics"])
    assert loaded["results"].count() == 3 and loaded["metrics"] is None
