"""Hand-checked cases of ranking, stores, sequences and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import catalog as R
from lattiq.operators import evolve, fronts, pareto, sequences, verify
from lattiq.operators.generators import benchmark
from lattiq.sources import sinks, tables


def points(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rows)], "uid int, o1 double, o2 double, cv double")


def test_fronts(spark):
    df = pareto.fronts(points(spark, [(0, 0, 0), (1, 2, 0), (2, 1, 0), (3, 3, 0)]), "uid", ["o1", "o2"], "cv")
    assert {r.uid: r.front for r in df.collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_feasible_beats_infeasible(spark):
    df = pareto.first_front(points(spark, [(5, 5, 0), (0, 0, 0.7)]), "uid", ["o1", "o2"], "cv")
    assert [r.uid for r in df.collect()] == [0]


def test_thresholds_and_violation(spark):
    def at(m):
        return spark.range(1).select(pareto.dead_threshold(F.lit(m), F.lit(m), F.lit(569.0))).first()[0]

    assert at(8) == pytest.approx(0.3) and at(12) == pytest.approx(0.605, abs=1e-3) and at(20) == pytest.approx(0.85, abs=1e-2)
    for dead, cv in ((0.4, 0.15), (0.6, 0.75), (0.85, 2.75)):
        got = spark.range(1).select(pareto.constraint_violation(F.lit(0.0), F.lit(0.0), F.lit(dead), F.lit(0.3))).first()[0]
        assert got == pytest.approx(cv)


def test_all_fronts_by_peeling(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(rng.integers(0, 12, 150), rng.integers(0, 12, 150), rng.choice([0, 0, 0, 0.5, 2.0], 150))]
    df = points(spark, rows)

    def beats(p, q):
        if p[2] == 0 and q[2] == 0:
            return p[0] <= q[0] and p[1] <= q[1] and p[:2] != q[:2]
        return p[2] == 0 or (q[2] != 0 and p[2] < q[2])

    left, want, k = set(rows), {}, 0
    while left:
        front = {q for q in left if not any(beats(p, q) for p in left)}
        want |= {q: k for q in front}
        left, k = left - front, k + 1
    for strip in (20_000, 20):
        got = pareto.fronts(df, "uid", ["o1", "o2"], "cv", strip=strip).collect()
        assert len(got) == len(rows) and all(want[r.o1, r.o2, r.cv] == r.front for r in got)
    assert {(r.o1, r.o2, r.cv) for r in pareto.first_front(df, "uid", ["o1", "o2"], "cv").collect()} == {q for q, f in want.items() if f == 0}


def peeled(x):
    """Front of each row of *x* by brute force."""
    out, left, k = {}, set(map(tuple, x.tolist())), 0
    while left:
        front = {q for q in left if not any(p != q and all(a <= b for a, b in zip(p, q)) for p in left)}
        out |= {q: k for q in front}
        left, k = left - front, k + 1
    return out


def test_ranks_in_strips_equal_peeling(spark):
    rng = np.random.default_rng(9)
    for x, strip in ((rng.integers(0, 30, (300, 2)), 40), (np.c_[np.zeros(60), np.arange(60)], 13), (np.c_[np.arange(50), 50 - np.arange(50)], 7), (rng.integers(0, 6, (120, 3)), 25), (rng.integers(0, 9, (30, 1)), 4)):
        x = np.unique(x.astype(float), axis=0)
        objs = [f"o{k}" for k in range(x.shape[1])]
        got = fronts.rank_points(spark.createDataFrame(x.tolist(), ", ".join(f"{o} double" for o in objs)), objs, strip).collect()
        assert {tuple(r)[:-1]: r.front for r in got} == peeled(x) and len(got) == len(x)


def test_ranks_of_missing_objectives_and_of_no_points(spark):
    schema = "o1 double, o2 double"
    got = fronts.rank_points(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (None, 9.0), (9.0, float("nan"))], schema), ["o1", "o2"], 1)
    assert sorted(r.front for r in got.collect()) == [0, 0, 0, 1]
    for objs in (["o1", "o2"], ["o1", "o2", "o3"]):
        none = spark.createDataFrame([], schema + ", o3 double").select(*objs)
        assert fronts.rank_points(none, objs).collect() == []
        assert pareto.fronts(none.withColumn("cv", F.lit(0.0)), "o1", objs, "cv").collect() == []


def test_hypervolume():
    assert pareto.hypervolume(np.array([[0.0, 0.0, 0.0]]), np.ones(3)) == pytest.approx(1)
    assert pareto.hypervolume(np.array([[0.0, 0.5], [0.5, 0.0]]), np.ones(2)) == pytest.approx(0.75)
    assert pareto.hypervolume(np.array([[2.0, 2.0]]), np.ones(2)) == 0


def test_gene_operators():
    space = {"a": {"type": "float", "min": 0.01, "max": 1.0, "log_scale": True}, "n": {"type": "int", "min": 1, "max": 9}, "k": {"type": "categorical", "values": ["x", "y"]}, "fixed": 3}
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = evolve.random_genes(space, rng), evolve.random_genes(space, rng)
        for g in (*evolve.crossover(a, b, space, rng), evolve.mutate(a, space, rng, 1.0)):
            assert 0.01 <= g["a"] <= 1 and 1 <= g["n"] <= 9 and isinstance(g["n"], int) and g["k"] in "xy" and g["fixed"] == 3
    assert evolve.uid_of({"b": 1, "a": 2, "uid": "z"}) == evolve.uid_of({"a": 2, "b": 1})


@pytest.fixture
def store(spark):
    rows = [(1, 0, 0, 0.10), (2, 0, 1, 0.12), (3, 1, 0, 0.09), (4, 1, 1, 0.14), (5, 1, 1, 0.13), (6, 1, 2, 0.11), (7, 2, 1, 0.08), (8, 2, 2, 0.07), (9, 0, 0, 0.45), (10, 2, 2, 0.52)]
    return spark.createDataFrame([("r", s, f"{i}_{j}", q) for s, i, j, q in rows], "run_id string, sample_id int, bmu_key string, qe double")


def test_neuron_errors(store):
    got = {r.neuron_key: (r.qe_mean, r.qe_max) for r in R.neuron_qe(store).collect()}
    assert got["0_0"] == (0.275, 0.45) and got["2_2"] == (0.295, 0.52) and len(got) == 7


def test_store_errors(spark, store):
    with pytest.raises(R.InvalidRequestError):
        R.list_anomalies(store, "r", -1)
    with pytest.raises(R.InvalidRequestError):
        R.list_clusters(store, store, "r", "other")
    with pytest.raises(R.NotFoundError):
        R.one(store, "run_id", "none")
    with pytest.raises(R.NotFoundError):
        R.compare_runs(spark.createDataFrame([("a",)], "id string"), ["a", "b"])
    with pytest.raises(R.ConflictError):
        R.insert(store, store, "run_id")
    assert R.list_anomalies(store, "r", 0).count() == 10


def test_tiles_equal_ntile(spark):
    from pyspark.sql import Window

    df = spark.range(103).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(7)))
    mine = {r.id: r.quartile for r in sequences.quartile_of(df, "v", "id").collect()}
    theirs = {r.id: r.q for r in df.withColumn("q", F.ntile(4).over(Window.orderBy("v", "id"))).collect()}
    assert mine == theirs


def test_perfect_and_random_map(spark):
    rng = np.random.default_rng(3)
    ij = rng.integers(0, 10, (400, 2))
    df = spark.createDataFrame([(int(i * 10 + j), float(i), float(j), float(j / 9), float(r)) for (i, j), r in zip(ij, rng.permutation(ij[:, 1]))], "nid int, i double, j double, u double, r double")
    assert verify.linear_r2(df, "u", "i", "j").first()[0] > 0.99
    assert verify.linear_r2(df, "r", "i", "j").first()[0] < 0.1
    assert verify.anova_r2(df, "nid", "u").first()[0] == pytest.approx(1.0)


def test_mann_whitney(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(20)] + [("b", float(k + 100)) for k in range(20)], "g string, v double")
    assert verify.mann_whitney(df, "g", "v", "a", "b")[1] < 1e-6
    assert verify.mann_whitney(df.where("v < 2"), "g", "v", "a", "b") is None


def test_generators_do_not_depend_on_partitions(spark):
    a = benchmark(spark, "torus", 50).orderBy("id").collect()
    assert a == benchmark(spark, "torus", 50).repartition(7).orderBy("id").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id, a\n1, 2.5\n\n,\n2, 3.5\n")
    df = tables.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.count() == 2 and df.columns == ["id", "a"]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "x.csv"), selected=["b"])
    assert tables.try_read(spark, str(tmp_path / "none")) is None
    (tmp_path / "c.json").write_text('{"a": [1, 2]}')
    assert tables.read_json(spark, str(tmp_path / "c.json")) == {"a": [1, 2]}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        tables.read_json(spark, str(tmp_path / "bad.json"))
    sinks.append_run(df, str(tmp_path / "store"), "metrics", "r1")
    sinks.append_run(df.limit(0), str(tmp_path / "store"), "coverage", "r1")
    sinks.overwrite_run(df.limit(1), str(tmp_path / "store"), "metrics", "r1")
    assert spark.read.parquet(str(tmp_path / "store/metrics")).count() == 1 and tables.try_read(spark, str(tmp_path / "store/coverage")) is None
