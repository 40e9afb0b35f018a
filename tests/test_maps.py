"""Hand-checked cases of maps, grids and schedules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import grid as G
from lattiq.operators import som as S


def column(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


def test_schedules(spark):
    assert column(spark, scalar.decay(F.lit(50), 101, 1.0, 0.0, "linear-drop")) == 0.5
    assert column(spark, scalar.decay(F.lit(0), 1, 0.7, 0.0, "exp-drop")) == 0.7
    assert column(spark, scalar.decay(F.lit(3), 5, 1.0, 0.1, "step-down")) == pytest.approx(0.343)
    assert column(spark, scalar.decay(F.lit(5), 10, 1.0, 0.0, "exp-drop", growth=0)) == 0.5
    with pytest.raises(ValueError):
        scalar.decay(F.lit(1), 10, 1.0, 0.0, "other")


def book(grid, weights, features="abc"):
    return S.Codebook(grid, tuple(features), np.asarray(weights, float).reshape(grid.size, len(features)))


def test_zero_map_has_the_distance_as_error(spark):
    g = G.Grid(6, 6, "square")
    df = spark.createDataFrame([(0.3, 0.0, 0.0)], "a double, b double, c double")
    assert S.map_quality(df, book(g, np.zeros((36, 3)))).first()["mqe"] == pytest.approx(0.3)


def test_dead_neurons(spark):
    g = G.Grid(6, 6, "square")
    w = np.ones((36, 3))
    w[0] = 0
    rows = spark.createDataFrame([(0.0, 0.0, 0.0)] * 10, "a double, b double, c double").withColumn("id", F.monotonically_increasing_id())
    a = S.assign(rows, book(g, w), ["id"])
    assert S.dead_neurons(a, g).first()["dead"] == 35
    assert S.dead_neurons(a.limit(0), g).first()["dead_ratio"] == 1.0


def test_coordinates_as_weights_have_no_topographic_error(spark):
    g = G.Grid(6, 6, "square")
    xy = [divmod(k, 6) for k in range(36)]
    cb = book(g, xy, "ab")
    rows = spark.createDataFrame([(i + 0.1, j + 0.1) for i, j in xy], "a double, b double")
    assert S.map_quality(rows, cb).first()["topographic_error"] == 0
    assert S.topological_correlation(cb, spark).first()[0] > 0.9
    flat = book(g, np.ones((36, 2)), "ab")
    assert S.topological_correlation(flat, spark).first()[0] == 0
    assert G.u_matrix_metrics(flat.frame(spark), g).first()["u_max"] == 0


def test_masked_cells_do_not_count(spark):
    g = G.Grid(2, 1, "square")
    cb = book(g, [(0.5, 0.5, 0.0), (0.7, 0.7, 0.9)])
    rows = spark.createDataFrame([(1, 0.5, 0.5, None), (2, 0.5, 0.5, 0.9)], "id long, a double, b double, c double")
    got = {r.id: r for r in S.assign(rows, cb, ["id"]).collect()}
    assert got[1].bmu_key == "0_0" and got[1].qe == 0 and got[1].qe_dims["c"] == 0
    assert got[2].bmu_key == "1_0"


def test_strategies_agree(spark):
    rng = np.random.default_rng(0)
    g = G.Grid(5, 4, "hex")
    cb = book(g, rng.random((20, 3)))
    x = rng.random((200, 3))
    rows = [(i, *(None if rng.random() < 0.1 else float(v) for v in r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    one = {r.id: (r.nid, r.nid2) for r in S.nearest(df, cb, 2).collect()}
    two = {r.id: (r.nid, r.nid2) for r in S._nearest_arrow(df, cb, 2).collect()}
    assert one == two


def test_hex_neighbours(spark):
    e = {(r.a, r.b) for r in G.Grid(3, 3, "hex").edges(spark).collect()}
    assert {b for a, b in e if a == 4} == {1, 2, 3, 5, 7, 8} and all((b, a) in e for a, b in e)


def planes(spark, m, n, f):
    return spark.createDataFrame([(i, j, "p", float(f(i, j))) for i in range(m) for j in range(n)], "i int, j int, feature string, v double")


def test_spatial_statistics(spark):
    assert G.spatial_stats(planes(spark, 12, 12, lambda i, j: i + j)).first()["morans_i"] > 0.8
    assert G.spatial_stats(planes(spark, 8, 8, lambda i, j: (i + j) % 2)).first()["morans_i"] < -0.9
    peak = G.spatial_stats(planes(spark, 11, 11, lambda i, j: (i, j) == (5, 5))).first()
    assert peak["n_local_maxima"] == 1
    flat = G.spatial_stats(planes(spark, 4, 4, lambda i, j: 1)).first()
    assert flat["morans_i"] is None and flat["n_local_maxima"] == 0
    assert G.spatial_stats(planes(spark, 1, 100, lambda i, j: j)).first()["gradient_mean"] == 1.0


def test_two_halves(spark):
    g = G.Grid(6, 6, "square")
    cells = g.neurons(spark).select("nid", "i", "j", F.when(F.col("j") < 3, "A").otherwise("B").alias("category"))
    r = G.regions(cells, g.edges(spark)).collect()
    assert len(r) == 2 and sum(x["size"] for x in r) == 36
    assert G.boundary_ratio(cells, g.edges(spark)).first()["boundary_ratio"] == 0.1


def test_training_separates_two_clusters(spark):
    rng = np.random.default_rng(42)
    low = [(float(a), float(b), "low") for a, b in zip(rng.normal(0.2, 0.03, 20), rng.normal(0.5, 0.05, 20))]
    high = [(float(a), float(b), "high") for a, b in zip(rng.normal(0.8, 0.03, 20), rng.normal(0.1, 0.02, 20))]
    df = spark.createDataFrame(low + high, "a double, b double, label string")
    cb, checkpoints = S.train(df, G.Grid(6, 6, "hex"), ["a", "b"], S.TrainSpec(epochs=5))
    assert checkpoints[-1]["mqe"] < checkpoints[0]["mqe"]
    seen = S.nearest(df, cb).groupBy("nid").agg(F.count_distinct("label").alias("k")).collect()
    assert all(r.k == 1 for r in seen)
    again, _ = S.train(df, G.Grid(6, 6, "hex"), ["a", "b"], S.TrainSpec(epochs=5))
    assert np.allclose(cb.weights, again.weights)


def test_online_training_and_sampling():
    order = list(S.sample_order(10, 2, 50.0, 4, np.random.default_rng(0), True))
    visits = np.bincount(np.concatenate(order), minlength=10)
    assert visits.max() - visits.min() <= 1
    x = np.random.default_rng(1).random((60, 2))
    w, visits, history = S.train_online(x, G.Grid(4, 4, "square"), {"seed": 3, "iterations": 30})
    assert history[-1]["mqe"] < history[0]["mqe"] and w.shape == (16, 2) and visits.sum() == 30 * 6


def test_roughness_is_the_u_matrix_maximum(spark):
    from lattiq.operators import many

    for m, n in ((4, 4), (3, 5), (1, 4), (4, 1)):
        g = G.Grid(m, n, "hex")
        cb = S.Codebook.random(g, ["a", "b"], 3)
        assert many.roughness(cb) == pytest.approx(G.u_matrix_metrics(cb.frame(spark), g).first()["u_max"], abs=1e-6)


def test_calibration_takes_the_larger_disorder(spark):
    from lattiq.operators import evolve

    rows = spark.range(200).select("id", (F.col("id") % 10 / 10.0).alias("a"), (F.col("id") % 7 / 7.0).alias("b"))
    space = {"map_size": {"type": "discrete_int_pair", "min": 2, "max": 4}, "start_rate": {"type": "float", "min": 0.1, "max": 0.9}, "iterations": 10, "percent": 50}
    limit, probes = evolve.calibrate(rows, "id", ["a", "b"], space, probes=5, seed=3)
    tops = sorted(max(r.u_max, r.d_max) for r in probes.collect())
    assert len(tops) == 5 and limit == pytest.approx(np.percentile(tops, 70), abs=1e-5)
    assert all('"iterations": 3' in r.genes for r in probes.collect())
    assert evolve.calibrate(rows, "id", ["a", "b"], space, probes=0)[0] == 1.0
