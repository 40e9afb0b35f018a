"""Queries: multi-objective ranking and search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import pareto as E
from lattiq.plans.maps import FEAT, FEATURES, GRID, feat
from lattiq.plans.registry import query
from lattiq.session import table

OBJS = ["o1", "o2"]
CAND = "cand AS (SELECT s_suppkey AS uid, round(s_acctbal / 10000, 4) AS o1, round((s_suppkey * 37 % 101) / 101.0::DOUBLE, 4) AS o2, CASE WHEN s_acctbal < 0 THEN round(-s_acctbal / 1000, 4) ELSE 0.0 END::DOUBLE AS cv, s_nationkey AS grp FROM supplier)"
DOM = "(CASE WHEN p.cv < 1e-9 AND q.cv < 1e-9 THEN p.o1 <= q.o1 AND p.o2 <= q.o2 AND (p.o1 < q.o1 OR p.o2 < q.o2) WHEN p.cv < 1e-9 THEN TRUE WHEN q.cv < 1e-9 THEN FALSE ELSE p.cv < q.cv END)"


def candidates(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("uid"),
        scalar.round_binary(F.col("s_acctbal") / 10000, 4).alias("o1"),
        scalar.round_binary((F.col("s_suppkey") * 37 % 101) / 101.0, 4).alias("o2"),
        F.when(F.col("s_acctbal") < 0, scalar.round_binary(-F.col("s_acctbal") / 1000, 4)).otherwise(0.0).alias("cv"),
        F.col("s_nationkey").alias("grp"),
    )


@query(f"WITH {CAND} SELECT uid, o1, o2, cv FROM cand q WHERE NOT EXISTS (SELECT 1 FROM cand p WHERE {DOM})")
def e1_e2_j9_first_front(spark, d):
    return E.first_front(candidates(spark, d), "uid", OBJS, "cv").select("uid", "o1", "o2", "cv")


@query(f"""WITH RECURSIVE {CAND}, r(uid, k) AS (SELECT uid, 0 FROM cand UNION SELECT q.uid, r.k + 1 FROM r JOIN cand p ON p.uid = r.uid JOIN cand q ON {DOM})
SELECT uid, max(k)::INTEGER AS front FROM r GROUP BY 1""")
def e2_fronts(spark, d):
    return E.fronts(candidates(spark, d), "uid", OBJS, "cv").select("uid", "front")


@query(f"""WITH {CAND}, w AS (SELECT *, max(o1) OVER g - min(o1) OVER g AS s1, max(o2) OVER g - min(o2) OVER g AS s2, lag(o1) OVER a AS b1, lead(o1) OVER a AS n1, lag(o2) OVER b AS b2, lead(o2) OVER b AS n2 FROM cand
 WINDOW g AS (PARTITION BY grp), a AS (PARTITION BY grp ORDER BY o1, uid), b AS (PARTITION BY grp ORDER BY o2, uid))
SELECT uid, grp, CASE WHEN isinf(c) THEN 1e9 ELSE round(c, 6) END::DOUBLE AS crowding FROM (SELECT uid, grp, CASE WHEN s1 < 1e-8 THEN 0 WHEN b1 IS NULL OR n1 IS NULL THEN 'inf'::DOUBLE ELSE (n1 - b1) / s1 END + CASE WHEN s2 < 1e-8 THEN 0 WHEN b2 IS NULL OR n2 IS NULL THEN 'inf'::DOUBLE ELSE (n2 - b2) / s2 END AS c FROM w)""")
def e3_w4_crowding(spark, d):
    c = E.crowding(candidates(spark, d), "uid", "grp", OBJS)
    return c.select("uid", "grp", F.when(F.col("crowding") == float("inf"), 1e9).otherwise(F.round("crowding", 6)).alias("crowding"))


@query(f"""WITH t AS (SELECT p_partkey, greatest(0.3, least(0.85, 1 - 569.0::DOUBLE / greatest(1, p_size * p_size) / 10)) AS lim, p_retailprice / 1000 AS u, p_size / 40.0::DOUBLE AS dead FROM part), x AS (SELECT *, round(greatest(0, dead - lim), 9) AS e FROM t)
SELECT p_partkey, round(lim, 6) AS threshold, round(greatest(0, greatest(u, 0) - 1) + e * CASE WHEN e = 0 THEN 0 WHEN e < 0.2 THEN 1.5 WHEN e < 0.4 THEN 2.5 ELSE 5 END, 6)::DOUBLE AS cv FROM x""")
def e5_e6_constraint(spark, d):
    t = table(spark, d, "part").select("p_partkey", E.dead_threshold(F.col("p_size"), F.col("p_size"), F.lit(569.0)).alias("lim"), (F.col("p_retailprice") / 1000).alias("u"), (F.col("p_size") / 40.0).alias("dead"))
    return t.select("p_partkey", F.round("lim", 6).alias("threshold"), F.round(E.constraint_violation(F.col("u"), F.lit(0.0), F.col("dead"), F.col("lim")), 6).alias("cv"))


@query("SELECT p_partkey, round(coalesce(NULLIF(p_size, 7) / 50.0::DOUBLE, p_retailprice / 2000, 1), 6) AS o1, round(coalesce(p_size / 100.0::DOUBLE, 1), 6) AS o2, round(1 - p_retailprice / 5000, 6) AS o3 FROM part")
def e7_objectives(spark, d):
    o = E.objectives(F.col("p_retailprice"), F.lit(2000.0), F.nullif("p_size", F.lit(7)) / 50.0, F.col("p_size") / 100.0, F.col("p_retailprice") / 5000)
    return table(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(f"o{k}") for k, c in enumerate(o, 1)])


@query(f"""WITH {CAND}, f AS (SELECT uid, o1, o2 FROM cand q WHERE NOT EXISTS (SELECT 1 FROM cand p WHERE {DOM})), n AS (SELECT a.uid, min(abs(a.o1 - b.o1) + abs(a.o2 - b.o2)) AS d FROM f a JOIN f b ON a.uid <> b.uid GROUP BY 1)
SELECT (SELECT count(*) FROM f) AS front_size, (SELECT round(max(o1) - min(o1), 6) FROM f) AS spread_o1, (SELECT round(max(o2) - min(o2), 6) FROM f) AS spread_o2, round(coalesce(stddev_pop(d), 0), 6) AS spacing FROM n""")
def e8_front_metrics(spark, d):
    return E.front_metrics(E.first_front(candidates(spark, d), "uid", OBJS, "cv"), "uid", OBJS)


@query(f"""WITH {CAND}, f AS (SELECT o1, min(o2) AS o2 FROM cand q WHERE NOT EXISTS (SELECT 1 FROM cand p WHERE {DOM}) AND o1 < 1.1 AND o2 < 1.1 GROUP BY 1), a AS (SELECT *, lag(o2) OVER (ORDER BY o1) AS above FROM f)
SELECT round(coalesce(sum((1.1::DOUBLE - o1) * (coalesce(above, 1.1::DOUBLE) - o2)), 0), 6)::DOUBLE AS hypervolume FROM a""")
def e8_hypervolume(spark, d):
    return E.hypervolume_2d(E.first_front(candidates(spark, d), "uid", OBJS, "cv"), OBJS, (1.1, 1.1))


@query(f"WITH {CAND} SELECT grp, count(*) AS members, count(*) FILTER (cv < 1e-9) AS feasible, min(o1) AS least_o1, min(o2) AS least_o2, min(cv) AS least_cv FROM cand GROUP BY 1")
def a24_archive_evolution(spark, d):
    return E.archive_evolution(candidates(spark, d), "grp", OBJS, "cv")


@query(f"WITH {CAND} SELECT q.uid, q.grp, count(p.uid) AS dominators FROM cand q LEFT JOIN cand p ON p.grp = q.grp + 1 AND {DOM} GROUP BY 1, 2")
def w12_next_dominators(spark, d):
    return E.next_dominators(candidates(spark, d), "uid", "grp", OBJS, "cv")


@query("WITH m AS (SELECT s_nationkey, max(s_acctbal) / 10000 AS top FROM supplier GROUP BY 1) SELECT round(coalesce(quantile_cont(top, 0.7), 1.0), 6)::DOUBLE AS \"limit\", count(top) AS probes FROM m")
def a33_calibration(spark, d):
    probes = table(spark, d, "supplier").groupBy("s_nationkey").agg((F.max("s_acctbal") / 10000).alias("top"))
    return E.calibrated_limit(probes, "top")


_PROBES = ((0, 37), (1, 5), (2, 11))
_PROBE_SQL = f"""WITH {FEAT}, cb AS (SELECT c, k AS nid, k // 4 AS i, k % 4 AS j, {', '.join(f'((k * a + {x * 11}) % 16) / 16.0::DOUBLE + 1 / 32.0::DOUBLE AS w{x}' for x in range(3))} FROM range(16) t(k), (VALUES {', '.join(map(str, _PROBES))}) v(c, a)),
e AS (SELECT c, id, nid, {', '.join(f'coalesce(x{x} - w{x}, 0) AS e{x}' for x in range(3))} FROM feat, cb), d AS (SELECT c, nid, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS qe, row_number() OVER (PARTITION BY c, id ORDER BY e0 * e0 + e1 * e1 + e2 * e2, nid) AS r FROM e),
dm AS (SELECT c, max(m) AS d_max FROM (SELECT c, nid, avg(qe) AS m FROM d WHERE r = 1 GROUP BY 1, 2) GROUP BY 1),
um AS (SELECT c, max(u) AS u_max FROM (SELECT a.c, a.nid, avg(sqrt(pow(a.w0 - b.w0, 2) + pow(a.w1 - b.w1, 2) + pow(a.w2 - b.w2, 2))) AS u FROM cb a JOIN cb b ON a.c = b.c AND abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT c, u_max, d_max, greatest(u_max, d_max) AS m FROM um JOIN dm USING (c))"""


@query(f"""{_PROBE_SQL} SELECT c AS config, round(u_max, 6) AS u_max, round(d_max, 6) AS d_max, round(m, 6) AS org_max, round((SELECT quantile_cont(m, 0.7) FROM o), 6) AS "limit" FROM o""")
def a33_probe_limits(spark, d):
    """Disorder of three probe maps over all orders, and the limit it calibrates."""
    from lattiq.operators import many
    from lattiq.operators.som import Codebook

    k, x = np.meshgrid(np.arange(16), np.arange(3), indexing="ij")
    books = [Codebook(GRID, tuple(FEATURES), ((k * a + x * 11) % 16) / 16.0 + 1 / 32) for _, a in _PROBES]
    rough = spark.createDataFrame([(no, many.roughness(b)) for no, b in enumerate(books)], "config int, u_max double")
    probes = many.quality(feat(spark, d), books).join(rough, "config").withColumn("org_max", F.greatest("u_max", "d_max"))
    limit = E.calibrated_limit(probes.where("org_max > 0"), "org_max").select("limit")
    return probes.join(F.broadcast(limit)).select("config", *[F.round(c, 6).alias(c) for c in ("u_max", "d_max", "org_max")], "limit")  # one row


@query(f"WITH {CAND} SELECT DISTINCT q.uid FROM cand q JOIN cand p ON {DOM}")
def e18_dominated_members(spark, d):
    return E.dominated_members(candidates(spark, d), "uid", OBJS, "cv").select("uid")


_NULLS = "n AS (SELECT uid, o1, CASE WHEN uid % 5 = 0 THEN NULL ELSE o2 END AS o2, 0.0::DOUBLE AS cv FROM cand)"
_SKIP = "(coalesce(p.o1 <= q.o1, TRUE) AND coalesce(p.o2 <= q.o2, TRUE) AND (coalesce(p.o1 < q.o1, FALSE) OR coalesce(p.o2 < q.o2, FALSE)))"


@query(f"WITH {CAND}, {_NULLS} SELECT uid FROM n q WHERE NOT EXISTS (SELECT 1 FROM n p WHERE {_SKIP})")
def e17_o12_merged_front(spark, d):
    n = candidates(spark, d).select("uid", "o1", F.when(F.col("uid") % 5 != 0, F.col("o2")).alias("o2"), F.lit(0.0).alias("cv"))
    return E.first_front(n, "uid", OBJS, "cv", skip_null=True).select("uid")


@query("""WITH l AS (SELECT 'p_type' AS parameter, p_type AS value, (p_size > 25)::INTEGER AS p FROM part UNION ALL SELECT 'p_brand', p_brand, (p_size > 25)::INTEGER FROM part), g AS (SELECT parameter, value, count(*) AS n, round(avg(p), 6) AS penalty_rate FROM l GROUP BY 1, 2)
SELECT *, CASE WHEN penalty_rate >= 0.95 THEN 'remove' ELSE 'restrict' END AS advice FROM g WHERE penalty_rate > 0.5""")
def e19_recommendations(spark, d):
    return E.recommendations(table(spark, d, "part").withColumn("pen", F.col("p_size") > 25), ["p_type", "p_brand"], "pen")


@query("""SELECT s_suppkey, round(CASE WHEN s_suppkey <= 10 THEN 30.0 WHEN s_suppkey >= 80 THEN 5.0 WHEN s_suppkey <= 40 THEN 30 * pow(15 / 30.0::DOUBLE, (ln(s_suppkey) - ln(10)) / (ln(40) - ln(10))) ELSE 15 * pow(5 / 15.0::DOUBLE, (ln(s_suppkey) - ln(40)) / (ln(80) - ln(40))) END, 2)::DOUBLE AS em FROM supplier WHERE s_suppkey > 0""")
def e12_log_interpolation(spark, d):
    x = F.col("s_suppkey").cast("double")
    return table(spark, d, "supplier").where("s_suppkey > 0").select("s_suppkey", scalar.log_interpolate(x, [(10, 30.0), (40, 15.0), (80, 5.0)]).alias("em"))


@query("SELECT p_partkey, md5('brand=' || p_brand || ';size=' || p_size || ';type=' || p_type) AS uid FROM part")
def e13_gene_uid(spark, d):
    genes = {"type": F.col("p_type"), "size": F.col("p_size"), "brand": F.col("p_brand"), "uid": F.lit("x")}
    return table(spark, d, "part").select("p_partkey", scalar.gene_uid(genes).alias("uid"))


@query()
def e9_e16_search(spark, d):
    from lattiq.operators.evolve import search

    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("a"), (F.col("s_nationkey") / 25.0).alias("b"))
    space = {
        "map_size": {"type": "discrete_int_pair", "min": 3, "max": 5},
        "map_type": {"type": "categorical", "values": ["hex", "square"]},
        "start_rate": {"type": "float", "min": 0.1, "max": 0.9, "log_scale": True},
        "num_batches": {"type": "int", "min": 1, "max": 4},
        "iterations": 8,
        "percent": 25,
    }
    return search(rows, "s_suppkey", ["a", "b"], space, population=4, generations=2, probes=3)
