"""Queries: aggregates and joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lattiq.operators import stats as A
from lattiq.plans.registry import query
from lattiq.session import table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def long_sql(table_name: str, cols: list[str], ids: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {ids + ', ' if ids else ''}'{c}' AS feature, {c}::DOUBLE AS value FROM {table_name} WHERE {c} IS NOT NULL" for c in cols)


@query(f"""SELECT feature, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median,
 round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95 FROM ({long_sql('lineitem', LINE)}) GROUP BY 1""")
def a1_global_stats(spark, d):
    return A.global_stats(table(spark, d, "lineitem"), LINE)


@query("SELECT event_type AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM events GROUP BY 1")
def a2_category_shares(spark, d):
    return A.category_shares(table(spark, d, "events"), "event_type")


@query(f"""SELECT l_returnflag, feature, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(coalesce(stddev_samp(value), 0), 4) AS std, min(value) AS min, max(value) AS max
FROM ({long_sql('lineitem', LINE, 'l_returnflag')}) GROUP BY 1, 2""")
def a3_cluster_stats(spark, d):
    return A.cluster_stats(table(spark, d, "lineitem"), "l_returnflag", LINE)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS s FROM c)
SELECT user_id, event_type AS dominant, s::BIGINT AS size, round(n / s::DOUBLE, 6) AS purity FROM r WHERE k = 1""")
def a4_dominant_purity(spark, d):
    return A.dominant(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT user_id, category, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type AS category FROM events)
LEFT JOIN (SELECT user_id AS u, event_type AS e, count(*) AS n FROM events GROUP BY 1, 2) ON u = user_id AND e = category""")
def a5_category_counts(spark, d):
    return A.category_counts(table(spark, d, "events"), "user_id", "event_type")


@query(f"""WITH l AS ({long_sql('lineitem', LINE, 'l_suppkey')}), g AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS s FROM l GROUP BY 1)
SELECT l_suppkey, feature, round((avg(value) - any_value(mu)) / any_value(s), 3) + 0.0::DOUBLE AS z FROM l JOIN g USING (feature) WHERE s > 0 GROUP BY 1, 2""")
def a6_deviation(spark, d):
    return A.deviation_from_global(table(spark, d, "lineitem"), "l_suppkey", LINE)


@query("SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS sample_ids, count(*) AS sample_count FROM customer GROUP BY 1")
def a7_cluster_ids(spark, d):
    return A.cluster_ids(table(spark, d, "customer"), "c_nationkey", "c_custkey")


@query("""SELECT l_suppkey, l_returnflag, round(avg(q), 6) AS qe_mean, max(q) AS qe_max, count(q) AS sample_count FROM (SELECT *, NULLIF(l_discount, 0.05) AS q FROM lineitem) WHERE q IS NOT NULL GROUP BY 1, 2""")
def a9_neuron_qe(spark, d):
    from lattiq.operators.catalog import neuron_qe

    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("bmu_key"), F.nullif("l_discount", F.lit(0.05)).alias("qe"))
    return neuron_qe(rows).select(F.col("run_id").alias("l_suppkey"), F.col("neuron_key").alias("l_returnflag"), "qe_mean", "qe_max", "sample_count")


@query("""SELECT dimension, round(avg(value), 6) AS mean, max(value) AS max, count(*) AS n FROM (SELECT 'k' AS dimension, (props->>'$.k')::DOUBLE AS value FROM events UNION ALL SELECT 'value', value FROM events) WHERE value IS NOT NULL GROUP BY 1""")
def a10_map_dimensions(spark, d):
    dims = F.map_concat(F.from_json("props", "map<string,double>"), F.create_map(F.lit("value"), F.col("value")))
    return A.map_dimension_means(table(spark, d, "events").select(dims.alias("dims")), "dims")


@query(f"""WITH l AS ({long_sql('lineitem', ['l_discount', 'l_tax'], 'l_suppkey, l_returnflag')}), m AS (SELECT l_suppkey, l_returnflag, feature, round(avg(value), 8) AS qe FROM l GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY qe DESC, feature) AS r FROM m)
SELECT l_suppkey, l_returnflag, feature AS top_dim, qe, round(qe / (SELECT max(qe) FROM t WHERE r = 1), 6) AS intensity FROM t WHERE r = 1""")
def a12_dominant_dimension(spark, d):
    long = A.long_form(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_discount", "l_tax"])
    mean = long.groupBy("l_suppkey", "l_returnflag", "feature").agg(F.round(F.avg("value"), 8).alias("qe"))
    top = mean.groupBy("l_suppkey", "l_returnflag").agg(F.min_by(F.struct("feature", "qe"), F.struct(-F.col("qe"), "feature")).alias("t"))
    most = top.agg(F.max("t.qe").alias("most"))
    return top.join(F.broadcast(most)).select("l_suppkey", "l_returnflag", F.col("t.feature").alias("top_dim"), F.col("t.qe").alias("qe"), F.round(F.col("t.qe") / F.col("most"), 6).alias("intensity"))  # one row


@query("""WITH c AS (SELECT l_suppkey, count(*)::DOUBLE AS x FROM lineitem GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x, l_suppkey) AS i FROM c)
SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r""")
def a14_gini(spark, d):
    return A.gini(table(spark, d, "lineitem").groupBy("l_suppkey").count(), "count")


@query("""WITH c AS (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1), r AS (SELECT n::DOUBLE AS x, row_number() OVER (ORDER BY n, p_partkey) AS i FROM c)
SELECT count(*) AS n, round(avg(x), 6) AS rate, round(stddev_pop(x), 6) AS std, round(avg((x = 0)::INTEGER), 6) AS never, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS p50,
 round(quantile_cont(x, 0.95), 6) AS p95, round(exp(-avg(x)), 6) AS never_poisson, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r""")
def a16_coverage_metrics(spark, d):
    visits = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("hits"))
    return A.coverage_metrics(table(spark, d, "part").select("p_partkey").join(visits, "p_partkey", "left").select(F.coalesce("hits", F.lit(0)).alias("hits")), "hits")


@query("""WITH c AS (SELECT p_partkey, any_value(p_retailprice) AS v, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1), e AS (SELECT quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM c)
SELECT len(list_filter(q, lambda x: x <= v))::INTEGER AS bin, count(*) AS n, round(avg(n), 6) AS mean_hits, round(avg((n = 0)::INTEGER), 6) AS never FROM c, e GROUP BY 1""")
def a17_quantile_bins(spark, d):
    visits = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("hits"))
    rows = table(spark, d, "part").join(visits, "p_partkey", "left").select("p_retailprice", F.coalesce("hits", F.lit(0)).alias("hits"))
    return A.quantile_bins(rows, "p_retailprice", "hits")


@query("""SELECT p_size AS generation, count(*) AS front_size, count(*) FILTER (p_retailprice < 1500) AS feasible, min(p_retailprice) AS best, round(quantile_cont(p_retailprice, 0.5), 4) AS median, max(p_retailprice) AS worst,
 round(avg(greatest(p_retailprice - 1500, 0)), 4) AS mean_cv FROM part GROUP BY 1""")
def a19_generation_stats(spark, d):
    r = F.col("p_retailprice")
    return table(spark, d, "part").groupBy(F.col("p_size").alias("generation")).agg(
        F.count(F.lit(1)).alias("front_size"), F.count_if(r < 1500).alias("feasible"), F.min(r).alias("best"), F.round(F.percentile(r, 0.5), 4).alias("median"), F.max(r).alias("worst"), F.round(F.avg(F.greatest(r - 1500, F.lit(0))), 4).alias("mean_cv")
    )


@query(f"""SELECT l_linenumber, feature AS metric, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
 round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75 FROM ({long_sql('lineitem', LINE, 'l_linenumber')}) GROUP BY 1, 2""")
def a20_parameter_distribution(spark, d):
    return A.summary_by(table(spark, d, "lineitem"), ["l_linenumber"], LINE)


@query("""SELECT count(*) AS n, count(*) FILTER (r <= 0.5) AS good, count(*) FILTER (r > 0.5 AND r <= 0.8) AS ok, count(*) FILTER (r > 0.8) AS bad, round(avg((p_type = 'PROMO')::INTEGER), 6) AS penalized, min(r) AS least, max(r) AS most FROM (SELECT *, round(p_size / 50.0::DOUBLE, 4) AS r FROM part)""")
def a22_run_overview(spark, d):
    r = F.col("r")
    x = table(spark, d, "part").withColumn("r", F.round(F.col("p_size") / 50.0, 4))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(r <= 0.5).alias("good"), F.count_if((r > 0.5) & (r <= 0.8)).alias("ok"), F.count_if(r > 0.8).alias("bad"), F.round(F.avg((F.col("p_type") == "PROMO").cast("double")), 6).alias("penalized"), F.min(r).alias("least"), F.max(r).alias("most"))


@query("""SELECT parameter, val AS value, count(*) AS n, round(avg(penal), 6) AS penalty_rate, min(p_retailprice) AS best FROM (
 SELECT 'p_type' AS parameter, p_type AS val, (p_size > 40)::INTEGER AS penal, p_retailprice FROM part UNION ALL SELECT 'p_brand', p_brand, (p_size > 40)::INTEGER, p_retailprice FROM part) GROUP BY 1, 2""")
def a23_penalty_by_parameter(spark, d):
    x = table(spark, d, "part").select("p_type", "p_brand", (F.col("p_size") > 40).cast("int").alias("penal"), "p_retailprice")
    long = x.unpivot(["penal", "p_retailprice"], ["p_type", "p_brand"], "parameter", "value")
    return long.groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("penal"), 6).alias("penalty_rate"), F.min("p_retailprice").alias("best"))


@query("""WITH s AS (SELECT l_linenumber AS seed, round(avg(l_discount), 6) AS mqe, round(avg(l_tax), 6) AS te FROM lineitem GROUP BY 1)
SELECT metric, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS min, max(value) AS max, list(value ORDER BY seed) AS seed_values FROM (SELECT seed, 'mqe' AS metric, mqe AS value FROM s UNION ALL SELECT seed, 'te', te FROM s) GROUP BY 1""")
def a25_multi_seed_summary(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_discount"), 6).alias("mqe"), F.round(F.avg("l_tax"), 6).alias("te"))
    long = A.long_form(s, ["seed"], ["mqe", "te"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda x: x["value"])
    return long.groupBy(F.col("feature").alias("metric")).agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), ordered.alias("seed_values"))


@query("""WITH g AS (SELECT l_suppkey AS ds, l_returnflag AS method, l_linenumber AS em, count(*) AS repeats, count(*) FILTER (l_discount > 0.005) AS met FROM lineitem GROUP BY 1, 2, 3)
SELECT ds, method, sum(repeats)::BIGINT AS runs, min(em) FILTER (met = repeats) AS min_em FROM g GROUP BY 1, 2""")
def a26_least_budget(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ds"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("em"))
    g = g.agg(F.count(F.lit(1)).alias("repeats"), F.count_if(F.col("l_discount") > 0.005).alias("met"))
    return g.groupBy("ds", "method").agg(F.sum("repeats").alias("runs"), F.min(F.when(F.col("met") == F.col("repeats"), F.col("em"))).alias("min_em"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(abs(y - p)), 5) AS mae, round(avg((y - p) * (y - p)), 5) AS mse, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(avg(abs((y - p) / y) * 100), 5) AS mean_pct,
 round(quantile_cont(abs((y - p) / y) * 100, 0.5), 5) AS median_pct, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 5) AS r2 FROM (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p FROM lineitem) GROUP BY 1""")
def a29_regression_metrics(spark, d):
    return A.regression_metrics(table(spark, d, "lineitem"), F.col("l_extendedprice") / 1000, F.col("l_quantity") * 1.5, ["l_returnflag"])


@query("""WITH c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT quality = 1 AS t, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)))
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
 round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 6) AS f1 FROM c""")
def a30_classification_metrics(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return A.classification_metrics(x, F.col("quality") == 1, F.col("n_chars") > 1000)


@query("""WITH x AS (SELECT event_id, abs(value - 20) AS err, ntile(4) OVER (ORDER BY value, event_id) AS quartile FROM events) SELECT quartile, count(*) AS n, round(avg(err), 5) AS mae FROM x GROUP BY 1""")
def a31_error_by_quartile(spark, d):
    from lattiq.operators.sequences import quartile_of

    x = quartile_of(table(spark, d, "events").select("event_id", "value"), "value", "event_id")
    return x.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("value") - 20)), 5).alias("mae"))


@query("""SELECT user_id, min(day) AS first, max(day) AS last, count(DISTINCT day) AS present, max(day) - min(day) + 1 - count(DISTINCT day) AS gaps FROM (SELECT user_id, day(ts)::INTEGER AS day FROM events) GROUP BY 1""")
def a32_presence_gaps(spark, d):
    from lattiq.operators.windows import presence_gaps

    return presence_gaps(table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day")), ["user_id"], "day")


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a34_distinct_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


# joins


@query("""SELECT l_suppkey, l_linenumber, count(*) AS n, count(*) FILTER (round(abs(l_discount - m) - 1.5 * s, 9) > 0) AS far FROM lineitem JOIN (SELECT l_suppkey, avg(l_discount) AS m, stddev_samp(l_discount) AS s FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1, 2""")
def j2_rows_with_group_stats(spark, d):
    l = table(spark, d, "lineitem")
    s = l.groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"))
    gap = F.abs(F.col("l_discount") - F.col("m"))
    x = l.select("l_suppkey", "l_linenumber", "l_discount").join(s, "l_suppkey", "left")
    return x.groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round(gap - 1.5 * F.col("s"), 9) > 0).alias("far"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS is_outlier FROM customer")
def j3_membership_flag(spark, d):
    hit = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(hit, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("is_outlier"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j4_missing_ids(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j5_assignments_with_truth(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")


@query("""SELECT n.n_nationkey, n.n_name, r_name, count(c_custkey) AS customers FROM nation n LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' GROUP BY 1, 2, 3""")
def j6_left_outer_composite(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.join(c, "n_nationkey", "left").select("n_nationkey", "n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""SELECT a.user_id, a.week AS week_a, b.week AS week_b, a.n - b.n AS delta FROM (SELECT user_id, (day(ts) - 1) // 7 AS week, count(*) AS n FROM events GROUP BY 1, 2) a
JOIN (SELECT user_id, (day(ts) - 1) // 7 AS week, count(*) AS n FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.week < b.week""")
def j8_seed_pairs(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.expr("(day(ts) - 1) div 7").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    a, b = g.alias("a"), g.alias("b")
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.week") < F.col("b.week")))
    return met.select("a.user_id", F.col("a.week").alias("week_a"), F.col("b.week").alias("week_b"), (F.col("a.n") - F.col("b.n")).alias("delta"))


@query("""SELECT o_orderkey, coalesce(c_name, 'unknown') AS name, coalesce(c_acctbal, 0) AS acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def j11_left_with_fallback(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("name"), F.coalesce("c_acctbal", F.lit(0.0)).alias("acctbal"))


@query("""WITH t AS (SELECT user_id, event_type, round(avg(value), 6) AS mqe FROM events GROUP BY 1, 2) SELECT t.user_id, t.event_type, t.mqe, round(b.mqe - t.mqe, 6) AS delta_mqe FROM t JOIN (SELECT user_id, mqe FROM t WHERE event_type = 'click') b USING (user_id) WHERE event_type <> 'click'""")
def j12_against_baseline(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mqe"))
    base = t.where("event_type = 'click'").select("user_id", F.col("mqe").alias("base"))
    return t.where("event_type <> 'click'").join(base, "user_id").select("user_id", "event_type", "mqe", F.round(F.col("base") - F.col("mqe"), 6).alias("delta_mqe"))


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j16_key_navigation(spark, d):
    by_customer = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = by_customer.join(table(spark, d, "customer"), "c_custkey").groupBy("c_nationkey").agg(F.sum("orders").alias("orders"), F.sum("total").alias("total"))
    return x.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "orders", F.round("total", 2).alias("total"))


@query("""WITH l AS (SELECT l_returnflag, l_linenumber, 'l_discount' AS metric, l_discount::DOUBLE AS v FROM lineitem UNION ALL SELECT l_returnflag, l_linenumber, 'l_quantity', l_quantity::DOUBLE FROM lineitem)
SELECT l_returnflag, l_linenumber, metric, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75 FROM l GROUP BY 1, 2, 3""")
def a21_a27_arm_report(spark, d):
    return A.summary_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], ["l_discount", "l_quantity"])


@query("""WITH c AS (SELECT user_id, count(*) AS seen, round(avg(value), 6) AS level FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, user_id, value, seen, level FROM events JOIN c USING (user_id)""")
def j13_trajectory_with_context(spark, d):
    """Steps of a trajectory beside the context of their run; steps without one are dropped."""
    e = table(spark, d, "events")
    context = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"), F.round(F.avg("value"), 6).alias("level"))
    return e.select("event_id", "user_id", "value").join(context, "user_id")
