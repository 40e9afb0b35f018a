"""Queries: the store of runs. Suppliers stand for runs, line items for assignments and anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lattiq.operators import catalog as R
from lattiq.plans.registry import query
from lattiq.session import table


def clusters(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), F.concat_ws("_", "l_returnflag", "l_linenumber").alias("neuron_key")).agg(F.count(F.lit(1)).alias("sample_count"))


def errors(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.concat_ws("_", "l_returnflag", "l_linenumber").alias("bmu_key"), F.nullif("l_discount", F.lit(0.05)).alias("qe"))
    return R.neuron_qe(a)


C = """c AS (SELECT l_suppkey AS run_id, l_returnflag || '_' || l_linenumber AS neuron_key, count(*) AS sample_count FROM lineitem GROUP BY 1, 2),
q AS (SELECT l_suppkey AS run_id, l_returnflag || '_' || l_linenumber AS neuron_key, round(avg(NULLIF(l_discount, 0.05)), 6) AS qe_mean, max(NULLIF(l_discount, 0.05)) AS qe_max FROM lineitem WHERE l_discount <> 0.05 GROUP BY 1, 2)"""


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_name = 'NATION_3'")
def r1_dataset_by_name(spark, d):
    return R.one(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "name", "NATION_3")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation")
def r2_update_dataset(spark, d):
    change = spark.createDataFrame([(3, "renamed", None)], "n_nationkey int, n_name string, n_regionkey int")
    return R.update(table(spark, d, "nation"), "n_nationkey", change)


@query("SELECT s_suppkey AS id, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def r3_runs_of_dataset(spark, d):
    n = R.one(table(spark, d, "nation"), "n_name", "NATION_3")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), "s_name", "n_name")


@query("SELECT s_suppkey::VARCHAR AS id, s_acctbal FROM supplier WHERE s_suppkey IN (3, 5, 7)")
def r4_compare_runs(spark, d):
    return R.compare_runs(table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_acctbal"), ["3", " 5", "7", "3"])


@query(f"""WITH {C}, a AS (SELECT l_suppkey AS run_id, count(*) AS n FROM lineitem WHERE l_discount > 0.095 GROUP BY 1) SELECT s_suppkey AS id, count(DISTINCT neuron_key) AS active, coalesce(any_value(a.n), 0) AS anomalies, greatest(0, 20 - count(DISTINCT neuron_key)) AS dead FROM supplier LEFT JOIN c ON c.run_id = s_suppkey LEFT JOIN a ON a.run_id = s_suppkey GROUP BY 1""")
def r5_a28_run_summary(spark, d):
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(5).alias("map_m"), F.lit(4).alias("map_n"))
    odd = table(spark, d, "lineitem").where("l_discount > 0.095").select(F.col("l_suppkey").alias("run_id"))
    return R.run_summary(runs, clusters(spark, d), odd).select("id", "active", "anomalies", "dead")


@query(f"WITH {C} SELECT (SELECT count(*) FROM supplier WHERE s_suppkey <> 4) AS runs, (SELECT count(*) FROM c WHERE run_id <> 4) AS clusters")
def r6_delete_cascade(spark, d):
    left = R.delete_cascade({"runs": table(spark, d, "supplier").withColumnRenamed("s_suppkey", "id"), "clusters": clusters(spark, d)}, "runs", "id", 4, "run_id")
    return left["runs"].agg(F.count(F.lit(1)).alias("runs")).join(F.broadcast(left["clusters"].agg(F.count(F.lit(1)).alias("clusters"))))  # one row each


@query(f"WITH {C} SELECT run_id, neuron_key, CASE WHEN run_id = 2 THEN -1 ELSE sample_count END AS sample_count FROM c")
def r7_replace_clusters(spark, d):
    c = clusters(spark, d)
    return R.replace_clusters(c, c.where("run_id = 2").withColumn("sample_count", F.lit(-1).cast("long")))


@query(f"WITH {C} SELECT run_id, neuron_key, sample_count, qe_mean, qe_max FROM c LEFT JOIN q USING (run_id, neuron_key) WHERE run_id = 3 ORDER BY coalesce(qe_max, 0) DESC, neuron_key LIMIT 7")
def r9_o3_list_clusters(spark, d):
    return R.list_clusters(clusters(spark, d), errors(spark, d), 3, "qe_max", 7)


@query("SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS sample_id, NULLIF(l_discount, 0.05) AS qe FROM lineitem WHERE l_suppkey = 3 ORDER BY qe DESC NULLS LAST, sample_id LIMIT 15")
def r10_o4_list_anomalies(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), F.nullif("l_discount", F.lit(0.05)).alias("qe"))
    return R.list_anomalies(a, 3, 15)


@query("""SELECT 'k' AS dimension, round(avg((props->>'$.k')::DOUBLE), 6) AS mean, max((props->>'$.k')::DOUBLE) AS max, count(*) AS n FROM events WHERE user_id = 3""")
def r11_dimensions_of_run(spark, d):
    from lattiq.operators.stats import map_dimension_means

    return map_dimension_means(table(spark, d, "events").where("user_id = 3").select(F.from_json("props", "map<string,double>").alias("dims")), "dims")


@query("SELECT user_id AS seed, event_id AS uid FROM events WHERE user_id = 5 AND event_type = 'purchase'")
def r13_pareto_of_seed(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("seed"), F.col("event_id").alias("uid"))
    return e.where("seed = 5")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey >= 1000) AS inserted, (SELECT count(*) FROM customer WHERE c_custkey < 1000) AS skipped")
def r14_insert_missing(spark, d):
    c = table(spark, d, "customer")
    return R.insert_missing(c.where("c_custkey < 1000"), c, ["c_custkey"])[1]


@query("SELECT 8 AS tables, CASE WHEN EXISTS (SELECT 1 FROM region) AND EXISTS (SELECT 1 FROM nation) AND EXISTS (SELECT 1 FROM customer) AND EXISTS (SELECT 1 FROM supplier) AND EXISTS (SELECT 1 FROM part) AND EXISTS (SELECT 1 FROM orders) AND EXISTS (SELECT 1 FROM lineitem) AND EXISTS (SELECT 1 FROM events) THEN 'ok' ELSE 'degraded' END AS status")
def r16_health(spark, d):
    h = R.health({n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}, expected=8)
    return spark.createDataFrame([(h["tables"], h["status"])], "tables int, status string")


@query("SELECT DISTINCT n_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def r17_datasets_in_use(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("n_name").alias("name")).distinct()


@query("""SELECT l_suppkey AS run_id, count(*) AS n, max(l_orderkey * 10 + l_linenumber) AS last FROM lineitem WHERE l_suppkey <> 3 GROUP BY 1
UNION ALL SELECT 3, (SELECT count(*) FROM lineitem WHERE l_suppkey = 3) + (SELECT count(*) FROM events), greatest((SELECT max(l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_suppkey = 3), (SELECT max(event_id) FROM events))""")
def r8_append_assignments(spark, d):
    """Events are uploaded as assignments of run 3; counts and last samples of all runs follow."""
    known = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"))
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    new = table(spark, d, "events").select(F.col("event_id").alias("sample_id"))
    return R.append_to_run(known, new, runs, 3).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("sample_id").alias("last"))


@query("""SELECT 'searches' AS name, count(*) AS left_over FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 'members', count(*) FROM supplier WHERE s_nationkey <> 4 UNION ALL SELECT 'genes', count(*) FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT 'regions', count(*) FROM region""")
def r15_delete_search(spark, d):
    """A search goes with its members and genes; tables that do not name it stay whole."""
    t = {"searches": table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), "members": table(spark, d, "supplier").select(F.col("s_nationkey").alias("search_id")), "genes": table(spark, d, "customer").select(F.col("c_nationkey").alias("search_id")), "regions": table(spark, d, "region")}
    left = R.delete_cascade(t, "searches", "id", 4, "search_id")
    counts = [x.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(n).alias("name"), "left_over") for n, x in left.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)
