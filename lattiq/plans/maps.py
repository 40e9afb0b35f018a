"""Queries: maps, their quality and geometry. The codebooks are deterministic, so that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import grid as G
from lattiq.operators import many as M
from lattiq.operators import som as S
from lattiq.operators import stats as A
from lattiq.plans.registry import query
from lattiq.session import table

FEATURES = ["x0", "x1", "x2"]
GRID = G.Grid(4, 4, "hex")
SQUARE = G.Grid(4, 4, "square")
BOOK = S.Codebook.lattice(GRID, FEATURES)


def feat(spark, d):
    """Orders as a masked feature matrix with a category."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 500000).alias("x0"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 100) / 100.0).alias("x1"),
        ((F.substring("o_orderpriority", 1, 1).cast("int") - 1) / 4.0).alias("x2"),
        F.col("o_orderpriority").alias("cat"),
    )


FEAT = """feat AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS x0, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 100) / 100.0::DOUBLE END AS x1,
 (substr(o_orderpriority, 1, 1)::INTEGER - 1) / 4.0::DOUBLE AS x2, o_orderpriority AS cat FROM orders)"""
CB = "cb AS (SELECT k AS nid, k // 4 AS i, k % 4 AS j, " + ", ".join(f"((k * 37 + {d * 11}) % 16) / 16.0::DOUBLE + 1 / 32.0::DOUBLE AS w{d}" for d in range(3)) + " FROM range(16) t(k))"
DIST = "dist AS (SELECT id, cat, nid, i, j, " + ", ".join(f"coalesce(x{d} - w{d}, 0) AS e{d}" for d in range(3)) + " FROM feat, cb)"
RANKED = "ranked AS (SELECT *, e0 * e0 + e1 * e1 + e2 * e2 AS d2, row_number() OVER (PARTITION BY id ORDER BY e0 * e0 + e1 * e1 + e2 * e2, nid) AS r FROM dist)"
BMU = "bmu AS (SELECT id, cat, nid, i, j, i || '_' || j AS bmu_key, sqrt(d2) AS qe, abs(e0) AS q0, abs(e1) AS q1, abs(e2) AS q2 FROM ranked WHERE r = 1)"
BASE = f"WITH {FEAT}, {CB}, {DIST}, {RANKED}, {BMU}"
XY = "xy AS (SELECT nid, i, j, j + 0.5::DOUBLE * (i % 2) AS x, i * (sqrt(3::DOUBLE) / 2) AS y, j - i // 2 AS q FROM cb)"
EDGES = "edges AS (SELECT a.nid AS a, b.nid AS b FROM cb a, cb b WHERE (abs((a.j - a.i // 2) - (b.j - b.i // 2)) + abs((-(a.j - a.i // 2) - a.i) - (-(b.j - b.i // 2) - b.i)) + abs(a.i - b.i)) / 2 = 1)"
ROOK = "rook AS (SELECT a.nid AS a, b.nid AS b FROM cb a, cb b WHERE abs(a.i - b.i) + abs(a.j - b.j) = 1)"
WDIST = "sqrt((a.w0 - b.w0) * (a.w0 - b.w0) + (a.w1 - b.w1) * (a.w1 - b.w1) + (a.w2 - b.w2) * (a.w2 - b.w2))"


def assigned(spark, d):
    return S.assign(feat(spark, d), BOOK, ["id", "cat"])


@query(f"""{BASE}, c AS (SELECT bmu_key, cat, count(*) AS n FROM bmu GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY bmu_key ORDER BY n DESC, cat) AS r, sum(n) OVER (PARTITION BY bmu_key) AS s FROM c)
SELECT bmu_key, sample_count, qe_mean, qe_max, cat AS dominant, round(n / s::DOUBLE, 6) AS purity FROM (SELECT bmu_key, count(*) AS sample_count, round(avg(qe), 6) AS qe_mean, round(max(qe), 6) AS qe_max FROM bmu GROUP BY 1) JOIN t USING (bmu_key) WHERE r = 1""")
def flagship_cluster_report(spark, d):
    a = assigned(spark, d)
    stats = a.groupBy("bmu_key").agg(F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("qe"), 6).alias("qe_mean"), F.round(F.max("qe"), 6).alias("qe_max"))
    return stats.join(A.dominant(a, "bmu_key", "cat").drop("size"), "bmu_key")


@query(f"{BASE} SELECT id, nid, i AS bmu_i, j AS bmu_j, bmu_key, round(qe, 9) AS qe, round(q0, 9) AS q0, round(q1, 9) AS q1, round(q2, 9) AS q2 FROM bmu")
def m2_m8_assignment(spark, d):
    a = assigned(spark, d)
    return a.select("id", "nid", "bmu_i", "bmu_j", "bmu_key", F.round("qe", 9).alias("qe"), *[F.round(F.col("qe_dims")[f"x{k}"], 9).alias(f"q{k}") for k in range(3)])


@query(f"{BASE} SELECT nid, count(*) AS n, round(avg(qe), 5) AS qe FROM bmu GROUP BY 1")
def m2_assignment_arrow(spark, d):
    near = S._nearest_arrow(feat(spark, d).select("id", *FEATURES), BOOK, 1)
    return near.groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sqrt("d2")), 5).alias("qe"))


@query("SELECT k::INTEGER AS nid, (k // 4)::INTEGER AS i, (k % 4)::INTEGER AS j, (k // 4) || '_' || (k % 4) AS neuron_key, round(k % 4 + 0.5 * (k // 4 % 2), 6)::DOUBLE AS x, round((k // 4) * sqrt(3::DOUBLE) / 2, 6) AS y FROM range(16) t(k)")
def m0_b10_grid(spark, d):
    return GRID.neurons(spark).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


def _schedule_sql() -> str:
    g, n = "10.0::DOUBLE", 50
    parts = {
        "static": "0.9",
        "linear-drop": f"0.9 + t / {n - 1}.0::DOUBLE * (0.1 - 0.9)",
        "exp-drop": f"0.9 + (1 - exp(-{g} * t / {n}.0)) / (1 - exp(-{g})) * (0.1 - 0.9)",
        "exp-growth": f"0.9 + (exp({g} * t / {n}.0) - 1) / (exp({g}) - 1) * (0.1 - 0.9)",
        "log-drop": f"0.9 + ln({g} * t + 1) / ln({g} * {n} + 1) * (0.1 - 0.9)",
        "step-down": "greatest(0.1, 0.9 * pow(0.7, least(t // 5, 9)))",
    }
    return " UNION ALL ".join(f"SELECT t, '{k}' AS kind, round(({e})::DOUBLE, 6) AS value FROM range({n}) x(t)" for k, e in parts.items())


@query(_schedule_sql())
def m1_schedules(spark, d):
    out = None
    for kind in ("static", "linear-drop", "exp-drop", "exp-growth", "log-drop", "step-down"):
        one = spark.range(50).select(F.col("id").alias("t"), F.lit(kind).alias("kind"), F.round(scalar.decay(F.col("id"), 50, 0.9, 0.1, kind), 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {CB} SELECT nid, round(w0 / sqrt(w0*w0 + w1*w1 + w2*w2), 6) AS w0, round(w1 / sqrt(w0*w0 + w1*w1 + w2*w2), 6) AS w1, round(w2 / sqrt(w0*w0 + w1*w1 + w2*w2), 6) AS w2 FROM cb")
def m4_unit_norm(spark, d):
    f = BOOK.unit_norm().frame(spark)
    return f.select(F.col("nid").cast("long").alias("nid"), *[F.round(F.col("w")[k], 6).alias(f"w{k}") for k in range(3)])


def _epoch_sql(radius: float) -> str:
    h = f"exp(-pow((abs((a.j - a.i // 2) - (b.j - b.i // 2)) + abs((-(a.j - a.i // 2) - a.i) - (-(b.j - b.i // 2) - b.i)) + abs(a.i - b.i)) / 2.0::DOUBLE, 2) / (2 * pow({radius}::DOUBLE, 2) + 1e-8))"
    s = ", ".join(f"coalesce(sum(x{k}), 0) AS s{k}, count(x{k}) AS c{k}" for k in range(3))
    w = ", ".join(f"round(sum(h * coalesce(s{k}, 0)) / sum(h * coalesce(c{k}, 0)), 6) AS w{k}" for k in range(3))
    return f"""{BASE}, sums AS (SELECT nid, {s} FROM bmu JOIN feat USING (id) GROUP BY 1), hh AS (SELECT a.nid AS a, b.nid AS b, {h} AS h FROM cb a, cb b)
SELECT a AS nid, {w} FROM hh LEFT JOIN sums ON nid = b GROUP BY 1"""


@query(_epoch_sql(1.0))
def m6_batch_epoch(spark, d):
    moved, _ = S.batch_epoch(feat(spark, d), BOOK, 1.0)
    return moved.frame(spark).select(F.col("nid").cast("long").alias("nid"), *[F.round(F.col("w")[k], 6).alias(f"w{k}") for k in range(3)])


@query()
def m7_batch_training(spark, d):
    _, checkpoints = S.train(feat(spark, d), GRID, FEATURES, S.TrainSpec(epochs=6))
    return spark.createDataFrame([(c["iteration"], c["progress"], c["mqe"], c["radius"]) for c in checkpoints], "iteration int, progress double, mqe double, radius double")


def _config(k: int) -> M.Config:
    return M.Config(f"r{k}", G.Grid(5, 5, "square"), seed=k, iterations=12, percent=15 * (k + 1), num_batches=3, reshuffle=k % 2 == 0)


@query()
def m3_m5_online_training(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 2000).alias("b"))
    configs = [_config(k) for k in range(4)]
    _, scores = M.train_together(rows, "p_partkey", ["a", "b"], configs)
    never = None
    for c in configs:
        one = M.visits(rows, "p_partkey", c).agg(F.lit(c.uid).alias("uid"), F.avg((F.col("visits") == 0).cast("double")).alias("never_visited"))
        never = one if never is None else never.unionByName(one)
    done = spark.createDataFrame([(s["uid"], s["mqe"], s["first_mqe"], s["te"], s["dead"]) for s in scores], "uid string, mqe double, first_mqe double, te double, dead double")
    return done.join(never, "uid")


def _draw_sql(k: int, t: str, key: str) -> str:
    """The choice of rows of configuration *k* at iteration *t*, in SQL."""
    c = _config(k)

    def h(*parts: str) -> str:
        return f"('0x' || substr(md5({key} || ':{c.seed}' || ':' || " + " || ':' || ".join(parts) + "), 1, 8))::BIGINT * 100"

    section = f"(('0x' || substr(md5({key} || ':{c.seed}'), 1, 8))::BIGINT % {c.num_batches})"
    if not c.reshuffle:
        return f"{h(section, repr('draw'), t)} < {c.percent} * 4294967296"
    turn, low = f"(({t}) * {c.percent} // 100)", f"(({t}) * {c.percent} % 100)"
    here, after = h(section, turn), h(section, f"({turn} + 1)")
    return f"(({here} >= {low} * 4294967296 AND {here} < ({low} + {c.percent}) * 4294967296) OR {after} < ({low} + {c.percent} - 100) * 4294967296)"


@query(" UNION ALL ".join(f"SELECT 'r{k}' AS uid, p_partkey, sum(({_draw_sql(k, 't', 'p_partkey')})::INTEGER)::INTEGER AS visits FROM part, range(12) x(t) GROUP BY 2" for k in range(2)))
def m3_a18_sample_visits(spark, d):
    rows = table(spark, d, "part").select("p_partkey")
    both = [M.visits(rows, "p_partkey", _config(k)).withColumn("uid", F.lit(f"r{k}")) for k in range(2)]
    return both[0].unionByName(both[1])


def _many_sql() -> str:
    h = "exp(-pow((abs((a.j - a.i // 2) - (b.j - b.i // 2)) + abs((-(a.j - a.i // 2) - a.i) - (-(b.j - b.i // 2) - b.i)) + abs(a.i - b.i)) / 2.0::DOUBLE, 2) / (2 * pow(1.5::DOUBLE, 2) + 1e-8))"
    s = ", ".join(f"coalesce(sum(x{k}), 0) AS s{k}, count(x{k}) AS c{k}" for k in range(3))
    w = ", ".join(f"round(any_value(w{k}) + 0.25 * (sum(h * coalesce(s{k}, 0)) / sum(h * coalesce(c{k}, 0)) - any_value(w{k})), 6) AS w{k}" for k in range(3))
    picked = " UNION ALL ".join(f"SELECT {k} AS config, id FROM feat WHERE {_draw_sql(k, '5', 'id')}" for k in range(2))
    return f"""{BASE}, picked AS ({picked}), sums AS (SELECT config, nid, {s} FROM picked JOIN bmu USING (id) JOIN feat USING (id) GROUP BY 1, 2), hh AS (SELECT a.nid AS a, b.nid AS b, {h} AS h FROM cb a, cb b),
grid AS (SELECT config, hh.*, w0, w1, w2 FROM hh, (SELECT DISTINCT config FROM picked), cb WHERE cb.nid = a)
SELECT grid.config, a AS nid, {w} FROM grid LEFT JOIN sums ON sums.nid = b AND sums.config = grid.config GROUP BY 1, 2"""


@query(_many_sql())
def m3_m5_sampled_epoch(spark, d):
    conditions = [M.chosen(F.col("id"), _config(k), F.lit(5)) for k in range(2)]
    moved = M.epoch(feat(spark, d), [BOOK, BOOK], conditions, [1.5, 1.5], [0.25, 0.25])
    rows = [(k, nid, *map(float, w)) for k, b in enumerate(moved) for nid, w in enumerate(b.weights)]
    return spark.createDataFrame(rows, "config int, nid long, w0 double, w1 double, w2 double").select("config", "nid", *[F.round(f"w{k}", 6).alias(f"w{k}") for k in range(3)])


@query(f"""{BASE}, best AS (SELECT id, max(nid) FILTER (r = 1) AS a, max(nid) FILTER (r = 2) AS b, sqrt(min(d2) FILTER (r = 1)) AS qe FROM ranked GROUP BY 1)
SELECT k AS config, count(*) AS n, round(avg(qe), 6) AS mqe, round(avg((NOT EXISTS (SELECT 1 FROM edges WHERE edges.a = best.a AND edges.b = best.b))::INTEGER), 6) AS te, round(1 - count(DISTINCT best.a) / 16.0::DOUBLE, 6) AS dead FROM best, range(2) x(k), (SELECT 1) GROUP BY 1""".replace(f"{BASE},", f"{BASE}, {EDGES},"))
def e9_population_quality(spark, d):
    q = M.quality(feat(spark, d), [BOOK, BOOK])
    return q.select(F.col("config").cast("long").alias("config"), "n", *[F.round(c, 6).alias(c) for c in ("mqe", "te", "dead")])


@query(f"{BASE} SELECT i || '_' || j AS neuron_key, coalesce(n, 0) AS hits, coalesce(m, 0)::DOUBLE AS qe_mean, coalesce(x, 0)::DOUBLE AS qe_max FROM cb LEFT JOIN (SELECT nid AS k, count(*) AS n, round(avg(qe), 6) AS m, round(max(qe), 6) AS x FROM bmu GROUP BY 1) ON k = nid")
def a8_k5_neuron_errors(spark, d):
    return S.neuron_report(assigned(spark, d), GRID)


@query(f"{BASE} SELECT 16 - count(DISTINCT nid) AS dead, round((16 - count(DISTINCT nid)) / 16.0::DOUBLE, 6) AS dead_ratio FROM bmu")
def a13_q6_dead_neurons(spark, d):
    return S.dead_neurons(assigned(spark, d), GRID)


@query(f"{BASE} SELECT bmu_key, round(avg(q0), 6) AS x0, round(avg(q1), 6) AS x1, round(avg(q2), 6) AS x2 FROM bmu GROUP BY 1")
def a11_neuron_dim_qe(spark, d):
    return assigned(spark, d).groupBy("bmu_key").agg(*[F.round(F.avg(F.col("qe_dims")[c]), 6).alias(c) for c in FEATURES])


@query(f"""{BASE}, s AS (SELECT count(*)::DOUBLE AS x, nid FROM bmu GROUP BY 2), r AS (SELECT x, row_number() OVER (ORDER BY x, nid) AS k FROM s)
SELECT count(*) AS active, (16 - count(*)) / 16.0::DOUBLE AS dead_ratio, max(x)::BIGINT AS max_size, min(x)::BIGINT AS min_size, quantile_cont(x, 0.5) AS median_size, sum(x)::BIGINT AS samples, round(2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r""")
def a15_topology_summary(spark, d):
    sizes = assigned(spark, d).groupBy("nid").agg(F.count(F.lit(1)).alias("x"))
    one = sizes.agg(F.count(F.lit(1)).alias("active"), F.max("x").alias("max_size"), F.min("x").alias("min_size"), F.percentile("x", 0.5).alias("median_size"), F.sum("x").alias("samples"))
    return one.join(F.broadcast(A.gini(sizes, "x"))).select("active", ((16 - F.col("active")) / 16.0).alias("dead_ratio"), "max_size", "min_size", "median_size", "samples", "gini")  # one row each


def _quality_sql(apart: str) -> str:
    return f"""{BASE} SELECT count(*) AS n, round(avg(sqrt(a.d2)), 6) AS mqe, round(avg(({apart})::INTEGER), 6) AS topographic_error FROM ranked a JOIN ranked b ON a.id = b.id AND a.r = 1 AND b.r = 2"""


@query(_quality_sql("(abs((a.j - a.i // 2) - (b.j - b.i // 2)) + abs((-(a.j - a.i // 2) - a.i) - (-(b.j - b.i // 2) - b.i)) + abs(a.i - b.i)) / 2 > 1"))
def q1_q2_map_quality_hex(spark, d):
    return S.map_quality(feat(spark, d), BOOK)


@query(_quality_sql("greatest(abs(a.i - b.i), abs(a.j - b.j)) > 1"))
def q2_map_quality_square(spark, d):
    return S.map_quality(feat(spark, d), S.Codebook.lattice(SQUARE, FEATURES))


@query(f"""WITH {CB}, {XY}, p AS (SELECT round({WDIST}, 9) AS dw, round(sqrt(pow(xa.x - xb.x, 2) + pow(xa.y - xb.y, 2)), 9) AS dg FROM cb a JOIN cb b ON a.nid < b.nid JOIN xy xa ON xa.nid = a.nid JOIN xy xb ON xb.nid = b.nid),
r AS (SELECT rank() OVER (ORDER BY dw) + (count(*) OVER (PARTITION BY dw) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY dg) + (count(*) OVER (PARTITION BY dg) - 1) / 2.0::DOUBLE AS b FROM p)
SELECT round(corr(a, b), 6) AS topological_correlation, count(*) AS pairs FROM r""")
def q3_topological_correlation(spark, d):
    return S.topological_correlation(BOOK, spark)


@query(f"""WITH {CB}, {ROOK}, s AS (SELECT r.a AS nid, any_value(a.i) AS i, any_value(a.j) AS j, sum({WDIST}) AS t FROM rook r JOIN cb a ON a.nid = r.a JOIN cb b ON b.nid = r.b GROUP BY 1),
u AS (SELECT t / (4 - (i = 0)::INTEGER - (i = 3)::INTEGER - (j = 0)::INTEGER - (j = 3)::INTEGER) AS u FROM s) SELECT round(avg(u), 6) AS u_mean, round(stddev_pop(u), 6) AS u_std, round(max(u), 6) AS u_max FROM u""")
def q4_u_matrix_metrics(spark, d):
    return G.u_matrix_metrics(BOOK.frame(spark), GRID)


@query(f"WITH {CB}, {EDGES} SELECT e.a::INTEGER AS nid, round(avg({WDIST}), 6) AS u FROM edges e JOIN cb a ON a.nid = e.a JOIN cb b ON b.nid = e.b GROUP BY 1")
def q5_v1_u_matrix(spark, d):
    return G.u_matrix(BOOK.frame(spark), GRID.edges(spark)).withColumn("u", F.round("u", 6))


@query(f"WITH {CB}, {EDGES} SELECT a::INTEGER AS a, b::INTEGER AS b FROM edges")
def g3_j10_hex_edges(spark, d):
    return GRID.edges(spark).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


@query(f"""WITH {CB}, {EDGES}, l AS (SELECT e.a, e.b, round({WDIST}, 6) AS length FROM edges e JOIN cb a ON a.nid = e.a JOIN cb b ON b.nid = e.b WHERE e.a < e.b)
SELECT a::INTEGER AS a, b::INTEGER AS b, length, length > (SELECT quantile_cont(length, 0.85) FROM l) AS stretched FROM l""")
def g3_stretched_edges(spark, d):
    return G.stretched_edges(BOOK.frame(spark), GRID.edges(spark)).withColumns({"a": F.col("a").cast("int"), "b": F.col("b").cast("int")})


@query(f"""WITH {FEAT}, {CB}, s AS (SELECT min(x0) AS lo, max(x0) AS hi FROM feat) SELECT i::INTEGER AS i, j::INTEGER AS j, round(lo + w0 * (hi - lo), 6) AS v FROM cb, s""")
def g4_component_plane(spark, d):
    span = feat(spark, d).agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"))
    p = G.planes(BOOK.frame(spark), FEATURES).where("feature = 'x0'")
    return p.join(F.broadcast(span)).select("i", "j", F.round(F.col("lo") + F.col("v") * (F.col("hi") - F.col("lo")), 6).alias("v"))  # one row


_NEAR = """g AS (SELECT feature, i, j, v, v - avg(v) OVER (PARTITION BY feature) AS z, lag(v) OVER r AS vl, lead(v) OVER r AS vr, lag(v) OVER c AS vu, lead(v) OVER c AS vd FROM pl WINDOW r AS (PARTITION BY feature, i ORDER BY j), c AS (PARTITION BY feature, j ORDER BY i)),
h AS (SELECT *, lead(z) OVER (PARTITION BY feature, i ORDER BY j) AS zr, lead(z) OVER (PARTITION BY feature, j ORDER BY i) AS zd, coalesce((vr - vl) / 2, vr - v, v - vl, 0) AS gx, coalesce((vd - vu) / 2, vd - v, v - vu, 0) AS gy FROM g),
x AS (SELECT p.feature, p.i, p.j, any_value(p.v) AS v, max(q.v) AS hi, min(q.v) AS lo FROM pl p JOIN pl q ON p.feature = q.feature AND abs(p.i - q.i) <= 1 AND abs(p.j - q.j) <= 1 GROUP BY 1, 2, 3)"""


@query(f"""WITH {CB}, pl AS (SELECT i, j, 'x0' AS feature, w0 AS v FROM cb UNION ALL SELECT i, j, 'x1', w1 FROM cb UNION ALL SELECT i, j, 'x2', w2 FROM cb), {_NEAR}
SELECT feature, round(avg(sqrt(gy * gy + gx * gx)), 4) AS gradient_mean, round(max(sqrt(gy * gy + gx * gx)), 4) AS gradient_max, round(avg(sqrt(gy * gy + gx * gx)) / stddev_pop(h.v), 4) AS roughness,
 round(count(*) / (count(zr) + count(zd))::DOUBLE * (coalesce(sum(z * zr), 0) + coalesce(sum(z * zd), 0)) / sum(z * z), 4) AS morans_i,
 count(*) FILTER (x.v = hi AND hi > lo) AS n_local_maxima, count(*) FILTER (x.v = lo AND hi > lo) AS n_local_minima FROM h JOIN x USING (feature, i, j) GROUP BY 1""")
def q9_spatial_stats(spark, d):
    return G.spatial_stats(G.planes(BOOK.frame(spark), FEATURES))


def cells(spark, d):
    top = A.dominant(assigned(spark, d), "nid", "cat").select("nid", F.col("dominant").alias("category"))
    return GRID.neurons(spark).join(top, "nid").select("nid", "i", "j", "category")


CELLS = "c AS (SELECT nid, i, j, cat, count(*) AS n FROM bmu GROUP BY 1, 2, 3, 4), cells AS (SELECT nid, i, j, cat AS category FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY n DESC, cat) AS r FROM c) WHERE r = 1)"


@query(f"""{BASE}, {CELLS}, {ROOK} SELECT round(avg((x.category <> y.category)::INTEGER), 6) AS boundary_ratio, count(*) AS pairs FROM rook JOIN cells x ON x.nid = a JOIN cells y ON y.nid = b WHERE a < b""")
def g2_boundary_ratio(spark, d):
    return G.boundary_ratio(cells(spark, d), GRID.edges(spark, rook=True))


@query(f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}, {CELLS}, {ROOK}, same AS (SELECT a, b FROM rook JOIN cells x ON x.nid = a JOIN cells y ON y.nid = b AND x.category = y.category),
reach(nid, r) AS (SELECT nid, nid FROM cells UNION SELECT same.b, reach.r FROM reach JOIN same ON same.a = reach.nid), lab AS (SELECT nid, min(r) AS region FROM reach GROUP BY 1)
SELECT region::INTEGER AS region, category, count(*) AS size, round(avg(i), 4) AS centre_i, round(avg(j), 4) AS centre_j FROM cells JOIN lab USING (nid) GROUP BY 1, 2 ORDER BY size DESC, region LIMIT 10""")
def g1_o7_regions(spark, d):
    return G.regions(cells(spark, d), GRID.edges(spark, rook=True))


def sample(spark, d, cap=2000):
    e = S.distance_sample(table(spark, d, "embeddings"), "vec_id", cap)
    w = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", "label", w.alias("v"), F.slice(w, 1, 1)[0].alias("i"), F.slice(w, 2, 1)[0].alias("j"))


SAMPLE = "s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, embedding[1]::DOUBLE AS i, embedding[2]::DOUBLE AS j FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 2000)"
VDIST = "sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k]))))"


@query(f"""WITH {SAMPLE}, p AS (SELECT a.vec_id AS p, b.vec_id AS q, round({VDIST}, 9) AS dx, round(sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)), 9) AS dg FROM s a JOIN s b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY dx, q) AS rx, row_number() OVER (PARTITION BY p ORDER BY dg, q) AS rg FROM p), n AS (SELECT count(*) AS n FROM s)
SELECT any_value(n) AS n, 5 AS k, round(1 - 2.0::DOUBLE / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(CASE WHEN rg <= 5 AND rx > 5 THEN rx - 5 ELSE 0 END), 6) AS trustworthiness,
 round(1 - 2.0::DOUBLE / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(CASE WHEN rx <= 5 AND rg > 5 THEN rg - 5 ELSE 0 END), 6) AS continuity FROM r, n""")
def q7_b5_w1_trust_continuity(spark, d):
    return S.trust_continuity(sample(spark, d), "vec_id", "v", "i", "j", 5)


@query(f"""WITH {SAMPLE}, d AS (SELECT a.vec_id AS p, a.label AS own, b.label AS other, avg({VDIST}) AS d FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
t AS (SELECT p, own, min(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM d GROUP BY 1, 2)
SELECT own AS cluster, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM t GROUP BY 1""")
def q8_silhouette(spark, d):
    return S.silhouette(sample(spark, d), "vec_id", "v", "label")


@query()
def g5_pca_projection(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    xy = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e)
    return xy.select("vec_id", vector_to_array("p").alias("p")).select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(f"{BASE} SELECT bmu_key, round(avg(x0), 6) AS colour FROM bmu JOIN feat USING (id) GROUP BY 1")
def g6_truth_per_neuron(spark, d):
    near = S.nearest(feat(spark, d).select("id", *FEATURES), BOOK)
    key = F.concat_ws("_", F.floor(F.col("nid") / 4).cast("int"), (F.col("nid") % 4).cast("int"))
    return near.groupBy(key.alias("bmu_key")).agg(F.round(F.avg("x0"), 6).alias("colour"))
