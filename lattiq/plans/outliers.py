"""Queries: anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.operators import outliers as X
from lattiq.operators import stats as A
from lattiq.plans.maps import BASE, assigned
from lattiq.plans.registry import query
from lattiq.session import table

COLS = ["p_size", "p_retailprice"]
LONG = "l AS (SELECT p_partkey, p_brand, 'p_size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, p_brand, 'p_retailprice', p_retailprice FROM part)"
LOCAL = f"""{LONG}, s AS (SELECT p_brand, feature, avg(value) AS mu, stddev_samp(value) AS sd, count(*) AS n FROM l GROUP BY 1, 2),
loc AS (SELECT p_partkey, p_brand, feature, value, round((value - mu) / sd, 4) AS z FROM l JOIN s USING (p_brand, feature) WHERE n >= 3 AND sd > 0 AND abs((value - mu) / sd) > 1.6)"""


def part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type", *COLS)


@query(f"""WITH {LONG}, s AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1),
r AS (SELECT p_partkey, printf('%s outlier: %.4f', feature, value) AS reason FROM l JOIN s USING (feature) WHERE abs(value - mu) > 1.6 * sd UNION ALL
 SELECT p_partkey, printf('%s minimum: %.4f', feature, value) FROM l JOIN s USING (feature) WHERE lo < hi AND value = lo UNION ALL SELECT p_partkey, printf('%s maximum: %.4f', feature, value) FROM l JOIN s USING (feature) WHERE lo < hi AND value = hi)
SELECT p_partkey, list(reason ORDER BY reason) AS reasons FROM r GROUP BY 1""")
def x1_global_extremes(spark, d):
    return X.global_extremes(part(spark, d), "p_partkey", COLS, 1.6)


@query(f"WITH {LOCAL} SELECT p_partkey, p_brand, feature, value, z FROM loc")
def x2_x3_local_outliers(spark, d):
    return X.local_outliers(part(spark, d), "p_partkey", "p_brand", COLS, 1.6)


@query(f"WITH {LOCAL} SELECT p_partkey, count(DISTINCT feature) AS n_dims, max(abs(z)) AS max_z, CASE WHEN count(DISTINCT feature) > 1 THEN 'multi_dim' ELSE 'numeric' END AS kind FROM loc GROUP BY 1")
def x3_local_kinds(spark, d):
    return X.local_kinds(X.local_outliers(part(spark, d), "p_partkey", "p_brand", COLS, 1.6), "p_partkey")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS s FROM c),
top AS (SELECT user_id, event_type AS dominant, round(n / s::DOUBLE, 6) AS purity FROM t WHERE r = 1 AND round(n / s::DOUBLE, 6) >= 0.22 AND round(n / s::DOUBLE, 6) < 1)
SELECT user_id, dominant, purity, sum(n)::BIGINT AS minority, string_agg(event_type, ',' ORDER BY event_type) AS others, 'cluster:' || user_id AS sample_id FROM top JOIN c USING (user_id) WHERE event_type <> dominant GROUP BY 1, 2, 3""")
def x4_categorical_minority(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type")
    return X.categorical_minority(e, "user_id", "event_type", 0.22)


@query("""WITH c AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5), g AS (SELECT user_id, event_id, round(sqrt((value - m) * (value - m)), 9) AS dist FROM events JOIN c USING (user_id)),
q AS (SELECT user_id, quantile_cont(dist, 0.5) AS med FROM g GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dist DESC, event_id) AS r FROM g)
SELECT user_id, event_id, round(dist / med, 4) AS ratio FROM f JOIN q USING (user_id) WHERE r = 1 AND med > 0 AND dist / med >= 3""")
def x5_one_of_n(spark, d):
    return X.one_of_n(table(spark, d, "events").select("user_id", "event_id", "value"), "event_id", "user_id", ["value"])


@query(f"""{BASE}, m AS (SELECT quantile_cont(qe, 0.5) AS m FROM bmu) SELECT id, round(qe, 6) AS qe, round(qe / m, 4) AS ratio, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 'x0' WHEN q1 >= q2 THEN 'x1' ELSE 'x2' END AS top_dim FROM bmu, m WHERE qe > 1.5 * m""")
def x8_x9_high_qe(spark, d):
    return X.high_qe(assigned(spark, d), "id", None, 1.5).withColumn("qe", F.round("qe", 6))


@query(f"""WITH {LOCAL}, k AS (SELECT p_partkey, count(DISTINCT feature) AS n_dims, CASE WHEN count(DISTINCT feature) > 1 THEN 'multi_dim' ELSE 'numeric' END AS kind FROM loc GROUP BY 1),
a AS (SELECT p_partkey, kind, CASE kind WHEN 'multi_dim' THEN 0 ELSE 2 END AS priority, n_dims, 'local' AS reason FROM k UNION ALL SELECT p_partkey, 'global_extreme', 3, 0, 'price' FROM part WHERE p_retailprice > 1050)
SELECT p_partkey, arg_min(kind, priority) AS kind, min(priority) AS priority, max(n_dims) AS n_dims, 0.0::DOUBLE AS qe, 0.0::DOUBLE AS ratio, list(DISTINCT reason ORDER BY reason) AS reasons FROM a GROUP BY 1 ORDER BY priority, n_dims DESC, p_partkey LIMIT 20""")
def x6_x10_o2_rank_anomalies(spark, d):
    p = part(spark, d)
    none = F.lit(None).cast("double")
    local = X.local_kinds(X.local_outliers(p, "p_partkey", "p_brand", COLS, 1.6), "p_partkey").select("p_partkey", "kind", "n_dims", none.alias("qe"), none.alias("ratio"), F.lit("local").alias("reason"))
    glob = p.where("p_retailprice > 1050").select("p_partkey", F.lit("global_extreme").alias("kind"), F.lit(0).cast("long").alias("n_dims"), none.alias("qe"), none.alias("ratio"), F.lit("price").alias("reason"))
    return X.rank_anomalies(local.unionByName(glob), "p_partkey", 20)


@query(f"""{BASE}, e AS (SELECT id, ['x0 high'] AS reasons FROM feat WHERE x0 > 0.9) SELECT id, reasons, bmu_key, round(qe, 6) AS qe FROM e JOIN bmu USING (id)""")
def x7_enrich_extremes(spark, d):
    a = assigned(spark, d)
    e = table(spark, d, "orders").where("o_totalprice / 500000 > 0.9").select(F.col("o_orderkey").alias("id"), F.array(F.lit("x0 high"), F.lit("id minimum")).alias("reasons"))
    return X.enrich_extremes(e, a, "id").withColumn("qe", F.round("qe", 6))


@query(f"""WITH {LOCAL}, g AS (SELECT feature, avg(value) AS mean, min(value) AS min, max(value) AS max FROM l GROUP BY 1)
SELECT p_partkey, feature, value, round(value - mean, 4) AS delta, round((value - mean) / abs(mean) * 100, 2) AS delta_pct,
 CASE WHEN value = min THEN 'min' WHEN value = max THEN 'max' WHEN abs((value - mean) / abs(mean) * 100) >= 50 THEN 'strong' WHEN abs((value - mean) / abs(mean) * 100) >= 20 THEN 'moderate' END AS flag FROM l JOIN g USING (feature) WHERE p_partkey IN (SELECT p_partkey FROM loc)""")
def x11_anomaly_records(spark, d):
    p = part(spark, d)
    found = X.local_outliers(p, "p_partkey", "p_brand", COLS, 1.6).select("p_partkey").distinct()
    stats = A.long_form(p, [], COLS).groupBy("feature").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return X.anomaly_records(p.join(found, "p_partkey", "left_semi"), "p_partkey", COLS, stats)


@query()
def x12_k6_context_documents(spark, d):
    from lattiq.sources.sinks import to_json_documents

    a = assigned(spark, d)
    report = a.groupBy("bmu_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qe"), 6).alias("qe_mean")).join(A.dominant(a, "bmu_key", "cat"), "bmu_key")
    return to_json_documents(report, "bmu_key")


@query()
def x13_b18_injected_anomalies(spark, d):
    from lattiq.operators.generators import trips

    t = trips(spark)
    found = X.local_outliers(t, "id", "destination_category", ["transport_cost", "cost_per_km"], 2.5).select("id").distinct()
    return X.detection_score(found, t, "id", "_anomaly_label")
