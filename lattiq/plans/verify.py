"""Queries: verification against ground truth, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import verify as V
from lattiq.operators.som import distance_sample
from lattiq.plans.registry import query
from lattiq.session import table

PTS = "pts AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 2000)"


def points(spark, d):
    e = distance_sample(table(spark, d, "embeddings"), "vec_id", 2000)
    return e.select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abc")])


@query("""WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, covar_pop(l_extendedprice, l_extendedprice) AS syy FROM lineitem)
SELECT round(((s1y * s22 - s2y * s12) * s1y + (s2y * s11 - s1y * s12) * s2y) / (s11 * s22 - s12 * s12) / syy, 6) AS linear_r2 FROM s""")
def b1_linear_r2(spark, d):
    return V.linear_r2(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")


@query(f"""WITH {PTS}, f AS (SELECT *, ntile(5) OVER (ORDER BY id) AS f FROM pts), p AS (SELECT x.f, x.id AS p, x.c AS y, z.c AS yb, row_number() OVER (PARTITION BY x.id ORDER BY round((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b), 9), z.id) AS r FROM f x JOIN f z ON x.f <> z.f),
g AS (SELECT f, p, any_value(y) AS y, avg(yb) AS g FROM p WHERE r <= 5 GROUP BY 1, 2), h AS (SELECT f, sum((y - g) * (y - g)) AS sse, var_pop(y) * count(*) AS sst FROM g GROUP BY 1) SELECT round(avg(1 - sse / sst), 6) AS knn_r2 FROM h""")
def b1_knn_r2(spark, d):
    return V.knn_r2(points(spark, d), "id", "c", ["a", "b"], 5)


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT round(1 - sum(n * v) / sum(n) / (SELECT var_pop(l_extendedprice) FROM lineitem), 6) AS anova_r2 FROM g""")
def b2_anova_r2(spark, d):
    return V.anova_r2(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS s_acctbal, 0.0::DOUBLE AS k FROM supplier")
def b3_standardise(spark, d):
    x = V.standardise(table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(3.0).alias("k")), ["s_acctbal", "k"])
    return x.withColumn("s_acctbal", F.round("s_acctbal", 6))


@query(f"""WITH {PTS}, p AS (SELECT round(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), 9) AS du, round(abs(x.c - y.c), 9) AS dv FROM pts x JOIN pts y ON x.id < y.id),
r AS (SELECT rank() OVER (ORDER BY du) + (count(*) OVER (PARTITION BY du) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY dv) + (count(*) OVER (PARTITION BY dv) - 1) / 2.0::DOUBLE AS b FROM p) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def b4_j14_distance_spearman(spark, d):
    return V.distance_spearman(points(spark, d), "id", ["a", "b"], ["c"])


def _ari(rows: str) -> str:
    return f"""(SELECT round((b - l * r / t) / ((l + r) / 2 - l * r / t), 6) FROM (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT count(*) AS n FROM {rows} GROUP BY u, v)) AS b, (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT count(*) AS n FROM {rows} GROUP BY u)) AS l,
 (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT count(*) AS n FROM {rows} GROUP BY v)) AS r, (SELECT count(*) * (count(*) - 1) / 2.0::DOUBLE FROM {rows}) AS t))"""


@query(f"WITH x AS (SELECT lang AS u, source AS v FROM documents) SELECT {_ari('x')} AS ari")
def b6_adjusted_rand(spark, d):
    return V.adjusted_rand(table(spark, d, "documents"), "lang", "source")


@query(f"""WITH e AS (SELECT source AS nid, lang AS label FROM documents), c AS (SELECT nid, label, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT nid, label AS dom, round(n / sum(n) OVER (PARTITION BY nid)::DOUBLE, 6) AS purity, row_number() OVER (PARTITION BY nid ORDER BY n DESC, label) AS r FROM c),
x AS (SELECT nid AS u, label AS v FROM e), y AS (SELECT dom AS u, label AS v FROM e JOIN t USING (nid) WHERE r = 1)
SELECT {_ari('x')} AS raw_ari, coalesce(CASE WHEN (SELECT count(DISTINCT u) FROM y) = 1 THEN 0.0 END, {_ari('y')})::DOUBLE AS merged_ari, (SELECT round(avg(purity), 6) FROM t WHERE r = 1) AS mean_purity""")
def b6_label_metrics(spark, d):
    return V.label_metrics(table(spark, d, "documents").select("source", "lang"), "source", "lang")


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS k, s_acctbal AS x1, ((s_suppkey * 37) % 101)::DOUBLE AS y1 FROM supplier), s AS (SELECT k, x1, y1, lead(x1) OVER (ORDER BY k) AS x2, lead(y1) OVER (ORDER BY k) AS y2 FROM p QUALIFY x2 IS NOT NULL)
SELECT count(*) FILTER (sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0 AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0) AS crossings, count(*) AS pairs
FROM s a JOIN s b ON b.k >= a.k + 2""")
def b7_j15_chain_crossings(spark, d):
    x = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", ((F.col("s_suppkey") * 37) % 101).cast("double").alias("y"))
    return V.chain_crossings(x, "s_suppkey", "s_acctbal", "y")


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 10000 >= 0.8 THEN 'PASS' WHEN s_acctbal / 10000 >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM supplier")
def b9_verdicts(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", scalar.verdict(F.col("s_acctbal") / 10000, 0.8, 0.5).alias("verdict"))


@query("WITH v AS (SELECT CASE WHEN s_acctbal / 10000 >= 0.8 THEN 1 WHEN s_acctbal / 10000 >= 0.5 THEN 2 ELSE 3 END AS s FROM supplier) SELECT CASE max(s) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' ELSE 'PASS' END AS overall FROM v")
def b9_overall_verdict(spark, d):
    return V.worst(b9_verdicts(spark, d), "verdict")


@query()
def b11_seed_stability(spark, d):
    """Adjusted Rand index between maps of two seeds, for every pair of seeds."""
    from lattiq.operators.grid import Grid
    from lattiq.operators.som import TrainSpec, nearest, train
    from lattiq.plans.maps import FEATURES, feat

    rows, out = feat(spark, d).select("id", *FEATURES), None
    for seed in range(3):
        cb, _ = train(rows, Grid(3, 3, "hex"), FEATURES, TrainSpec(epochs=3, seed=seed))
        one = nearest(rows, cb).select("id", F.lit(seed).alias("seed"), "nid")
        out = one if out is None else out.unionByName(one)
    a, b = out.alias("a"), out.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.seed") < F.col("b.seed"))).select(F.col("a.seed").alias("seed_a"), F.col("b.seed").alias("seed_b"), F.col("a.nid").alias("u"), F.col("b.nid").alias("v"))
    return V.adjusted_rand(pairs, "u", "v", ["seed_a", "seed_b"])


@query()
def b13_mann_whitney(spark, d):
    found = V.mann_whitney(table(spark, d, "lineitem").where("l_linenumber <= 2"), "l_linenumber", "l_extendedprice", 1, 2)
    return spark.createDataFrame([found or (None, None)], "u double, p double")


@query()
def b16_benchmarks(spark, d):
    from lattiq.operators.generators import benchmark

    out = None
    for kind in ("swiss_roll", "s_curve", "helix", "torus", "blobs", "noisy_plane", "uniform_cube", "space_filling"):
        g = benchmark(spark, kind)
        x = [c for c in g.columns if c != "id" and not c.startswith("gt_")][0]
        one = g.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def b17_schema_data(spark, d):
    from lattiq.operators.generators import from_schema

    return from_schema(spark, {"age": {"type": "int", "min": 18, "max": 90}, "city": {"type": "category", "values": ["a", "b", "c"], "null_share": 0.1}, "score": {"type": "normal", "mean": 5, "std": 2}}, 500, 1)
