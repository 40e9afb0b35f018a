"""Queries: a whole engine run over orders, read back from what it published."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattiq.operators import engine
from lattiq.plans import maps
from lattiq.plans.registry import query
from lattiq.session import scratch_root, table

CONFIG = engine.RunConfig("id", ("x0", "x1"), ("x2",), grid=(4, 4, "hex"), epochs=0, start="lattice")


def orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("x0"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 100).alias("x1"), F.col("o_orderpriority").alias("x2")
    )


def published(spark, d, name):
    root = f"{scratch_root(spark)}/engine-{uuid.uuid4().hex}"
    engine.run(orders(spark, d), CONFIG, root, "orders")
    return engine.published(spark, root, "orders", name), root


FEAT = """raw AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS a, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 100)::DOUBLE END AS b, o_orderpriority AS cat, dense_rank() OVER (ORDER BY o_orderpriority) - 1.0::DOUBLE AS c FROM orders),
feat AS (SELECT id, cat, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS x0, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS x1, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS x2 FROM raw)"""
BASE = f"WITH {FEAT}, {maps.CB}, {maps.DIST}, {maps.RANKED}, {maps.BMU}"
EXTREME = """l AS (SELECT id, 'x0' AS f, x0 AS v FROM feat UNION ALL SELECT id, 'x1', x1 FROM feat UNION ALL SELECT id, 'x2', x2 FROM feat), st AS (SELECT f, avg(v) AS mu, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1),
ext AS (SELECT DISTINCT id FROM l JOIN st USING (f) WHERE v IS NOT NULL AND (abs(v - mu) > 2.5 * sd OR (lo < hi AND (v = lo OR v = hi))))"""


@query(f"{BASE} SELECT bmu_key, count(*) AS sample_count, round(avg(qe), 6) AS qe_mean, round(max(qe), 6) AS qe_max FROM bmu GROUP BY 1")
def m10_run_clusters(spark, d):
    return published(spark, d, "clusters")[0]


@query(f"{BASE} SELECT i || '_' || j AS neuron_key, coalesce(n, 0) AS hits, coalesce(m, 0)::DOUBLE AS qe_mean, coalesce(x, 0)::DOUBLE AS qe_max FROM cb LEFT JOIN (SELECT nid AS k, count(*) AS n, round(avg(qe), 6) AS m, round(max(qe), 6) AS x FROM bmu GROUP BY 1) ON k = nid")
def m10_run_errors(spark, d):
    return published(spark, d, "neuron_errors")[0]


@query(f"{BASE}, {EXTREME} SELECT id, i AS bmu_i, j AS bmu_j, bmu_key, round(qe, 6) AS qe, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2, id IN (SELECT id FROM ext) AS is_outlier FROM bmu")
def m9_k4_run_assignments(spark, d):
    a = published(spark, d, "assignments")[0]
    return a.select("id", "bmu_i", "bmu_j", "bmu_key", "qe", *[F.col("qe_dims")[f"x{k}"].alias(f"q{k}") for k in range(3)], "is_outlier")


@query(f"{BASE} SELECT bmu_key, 'x2' AS feature, cat AS category, count(*) AS n FROM bmu GROUP BY 1, 3")
def m9_run_category_shares(spark, d):
    return published(spark, d, "category_shares")[0]


@query(f"WITH {FEAT} SELECT id, id IS NOT NULL AS m_id, a IS NULL AS m_x0, b IS NULL AS m_x1, cat IS NULL AS m_x2, round(x0, 9) AS x0, round(x1, 9) AS x1, round(x2, 9) AS x2 FROM feat JOIN raw USING (id, cat)")
def k3_run_prepared(spark, d):
    mask, root = published(spark, d, "mask")
    scaled = engine.published(spark, root, "orders", "normalized")
    return mask.join(scaled, "id").select("id", F.col("id").isNotNull().alias("m_id"), "m_x0", "m_x1", "m_x2", *[F.round(f"x{k}", 9).alias(f"x{k}") for k in range(3)])


@query(f"""{BASE}, {EXTREME}, a AS (SELECT count(*) AS rows, round(avg(round(qe, 6)), 6) AS mqe, (SELECT count(*) FROM ext) AS outliers FROM bmu), n AS (SELECT 16 AS rows, round((16 - count(DISTINCT nid)) / 16.0::DOUBLE, 6) AS dead_ratio FROM bmu)
SELECT a.rows AS samples, mqe, outliers::DOUBLE AS outliers, n.rows AS neurons, dead_ratio FROM a, n""")
def k2_run_figures(spark, d):
    _, root = published(spark, d, "clusters")
    f = engine.run_figures(spark, root)

    def seen(table_name, figure=None):
        return F.max(F.when(F.col("table") == table_name, F.col("figures")[figure] if figure else F.col("rows")))

    return f.agg(
        seen("assignments").alias("samples"), F.round(seen("assignments", "mqe"), 6).alias("mqe"), seen("assignments", "outliers").alias("outliers"),
        seen("neuron_errors").alias("neurons"), F.round(seen("neuron_errors", "dead_ratio"), 6).alias("dead_ratio"),
    )
