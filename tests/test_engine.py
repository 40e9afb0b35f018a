"""Engine runs: training, publishing, and what readers see."""

import json

import pytest
from pyspark.sql import functions as F

from lattiq.operators import engine


@pytest.fixture()
def rows(spark):
    return spark.range(400).select("id", (F.col("id") % 20 / 20.0).alias("a"), F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("double")).alias("b"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"))


CONFIG = engine.RunConfig("id", ("a", "b"), ("c",), grid=(4, 4, "hex"), epochs=4)


def test_a_run_publishes_all_its_tables(spark, rows, tmp_path):
    manifest = engine.run(rows, CONFIG, str(tmp_path), "r1")
    figures = json.loads(manifest["figures"])
    assert set(figures) == set(engine.TABLES)
    for name in engine.TABLES:
        assert engine.published(spark, str(tmp_path), "r1", name).count() == figures[name]["rows"]
    a = engine.published(spark, str(tmp_path), "r1", "assignments")
    assert a.count() == 400 and a.agg(F.avg("qe")).first()[0] == pytest.approx(figures["assignments"]["mqe"])
    errors = [r.mqe for r in engine.published(spark, str(tmp_path), "r1", "checkpoints").orderBy("iteration").collect()]
    assert len(errors) == 4 and errors[-1] < errors[1]  # falls with the radius; the start is scattered over the data


def test_readers_see_all_or_nothing(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        engine.published(spark, root, "r1", "clusters")
    write = engine._write
    monkeypatch.setattr(engine, "_write", lambda df, folder, name: (_ for _ in ()).throw(OSError()) if name == "clusters" else write(df, folder, name))
    with pytest.raises(OSError):
        engine.run(rows, CONFIG, root, "r1")
    with pytest.raises(LookupError):  # tables were written, but nothing was published
        engine.published(spark, root, "r1", "assignments")
    assert engine.run_figures(spark, root).count() == 0
    monkeypatch.undo()
    engine.run(rows, CONFIG, root, "r1")
    assert engine.published(spark, root, "r1", "assignments").count() == 400
    engine.run(rows.where("id < 100"), CONFIG, root, "r1")  # a repeated run replaces all tables at once
    engine.run(rows.where("id < 50"), CONFIG, root, "r2")
    assert engine.published(spark, root, "r1", "assignments").count() == 100
    assert {r.run_id: r.rows for r in engine.run_figures(spark, root).where("table = 'assignments'").collect()} == {"r1": 100, "r2": 50}


def test_wrong_tables_are_refused(spark, rows, tmp_path):
    with pytest.raises(ValueError):
        engine.run(rows.drop("b"), CONFIG, str(tmp_path), "r1")
    with pytest.raises(ValueError):
        engine.run(rows.where("false"), CONFIG, str(tmp_path), "r1")
