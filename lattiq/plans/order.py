"""Queries: windows, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.operators import windows as W
from lattiq.plans.registry import query
from lattiq.session import table

SEQ = "ORDER BY ts, event_id"


def events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")


@query("""WITH r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def w2_spearman(spark, d):
    return W.spearman(events(spark, d), "value", "event_id", ["user_id"]).withColumn("rho", F.round("rho", 6))


@query(f"""SELECT user_id, event_id, round(value / greatest(first_value(value) OVER (PARTITION BY user_id {SEQ}), 1e-10), 6) AS rel FROM events""")
def w5_relative_to_first(spark, d):
    return events(spark, d).select("user_id", "event_id", F.round(W.relative_to_first("value", ["user_id"], ["ts", "event_id"]), 6).alias("rel"))


@query(f"""WITH m AS (SELECT user_id, event_id, ts, row_number() OVER w AS no, CASE WHEN row_number() OVER w >= 5 THEN round(avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS moving FROM events WINDOW w AS (PARTITION BY user_id {SEQ})),
b AS (SELECT *, min(moving) OVER (PARTITION BY user_id {SEQ} ROWS UNBOUNDED PRECEDING) AS best, min(moving) OVER (PARTITION BY user_id {SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m),
a AS (SELECT *, max(CASE WHEN moving IS NOT NULL AND (prev IS NULL OR moving < prev) THEN no END) OVER (PARTITION BY user_id {SEQ} ROWS UNBOUNDED PRECEDING) AS no_best FROM b)
SELECT user_id, event_id, moving, best, CASE WHEN moving IS NOT NULL THEN no - no_best END AS since_best, coalesce(CASE WHEN moving IS NOT NULL THEN no - no_best END >= 10, FALSE) AS stop FROM a""")
def w6_early_stopping(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pre = events(spark, d).withColumn("m", F.when(F.row_number().over(w) >= 5, F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6)))
    return W.early_stopping(pre, "m", ["user_id"], ["ts", "event_id"], 1, 10).select("user_id", "event_id", "moving", "best", "since_best", "stop")


@query(f"SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id {SEQ} ROWS UNBOUNDED PRECEDING) AS best FROM events")
def w7_best_so_far(spark, d):
    return events(spark, d).select("user_id", "event_id", W.best_so_far("value", ["user_id"], ["ts", "event_id"]).alias("best"))


@query("""WITH g AS (SELECT event_type, day(ts) AS g, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2), c AS (SELECT event_type, g, min(lo) OVER w AS lo, max(hi) OVER w AS hi FROM g WINDOW w AS (PARTITION BY event_type ORDER BY g ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(greatest(0, least(1.1, (value - lo) / CASE WHEN hi - lo < 1e-9 THEN 1 ELSE hi - lo END)), 6)::DOUBLE AS normalised FROM events e JOIN c ON c.event_type = e.event_type AND c.g = day(ts)""")
def w8_running_range(spark, d):
    x = W.running_normalised(events(spark, d).withColumn("g", F.dayofmonth("ts")), "value", "g", ["event_type"])
    return x.select("event_id", F.round("normalised", 6).alias("normalised"))


@query("""WITH s AS (SELECT user_id, (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY user_id) - 1)::DOUBLE AS x, value AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT DISTINCT user_id, k / 9.0::DOUBLE AS g FROM events, range(10) t(k)),
b AS (SELECT g.user_id, g, max_by(y, x) FILTER (x <= g) AS y0, max(x) FILTER (x <= g) AS x0, min_by(y, x) FILTER (x >= g) AS y1, min(x) FILTER (x >= g) AS x1 FROM g JOIN s USING (user_id) GROUP BY 1, 2)
SELECT user_id, round(g, 6) AS position, round(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (g - x0) / (x1 - x0) * (y1 - y0) END, 6) AS value FROM b""")
def w9_resample(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = (F.row_number().over(w) - 1) / (F.count(F.lit(1)).over(Window.partitionBy("user_id")) - 1)
    out = W.resample(events(spark, d).select("user_id", x.alias("x"), "value"), "user_id", "x", "value", 10)
    return out.select("user_id", F.round("at", 6).alias("position"), F.round("value", 6).alias("value"))


@query(f"""WITH s AS (SELECT user_id, list(value {SEQ}) AS seq FROM events GROUP BY 1) SELECT user_id, share, seq[1:greatest(2, round_even(share * len(seq), 0)::INTEGER)] AS prefix FROM s, (VALUES (0.2::DOUBLE), (0.3), (0.5), (0.7)) t(share)""")
def w10_prefix_windows(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])
    return W.prefix_windows(events(spark, d).groupBy("user_id").agg(ordered.alias("seq")), "seq", [0.2, 0.3, 0.5, 0.7]).select("user_id", "share", "prefix")


@query("""WITH b AS (SELECT l_returnflag, l_linenumber, round(avg(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1, 2), g AS (SELECT *, (m - lead(m) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber)) / m AS gain FROM b)
SELECT l_returnflag, l_linenumber, round(gain, 8) AS gain, coalesce(max(gain) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < 0.02, TRUE) AS saturated FROM g""")
def w11_saturation(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("m"))
    return W.saturation(b, ["l_returnflag"], "l_linenumber", "m").select("l_returnflag", "l_linenumber", F.round("gain", 8).alias("gain"), "saturated")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def w13_keep_highest(spark, d):
    return W.keep_first(events(spark, d), ["user_id", "event_type"], [F.desc("value"), "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT l_suppkey, count(*) AS sample_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def o1_largest_clusters(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("sample_count")).orderBy(F.desc("sample_count"), "l_suppkey").limit(20)


@query("""WITH f AS (SELECT s_suppkey, 'acctbal' AS feature, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_samp(s_acctbal) FROM supplier), 3) AS z FROM supplier UNION ALL
 SELECT s_suppkey, 'nation', round((s_nationkey - (SELECT avg(s_nationkey) FROM supplier)) / (SELECT stddev_samp(s_nationkey) FROM supplier), 3) FROM supplier)
SELECT s_suppkey, feature, z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(z) DESC, feature) AS r FROM f) WHERE r <= 1""")
def o5_top_features(spark, d):
    from lattiq.operators.outliers import top_features

    x = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return top_features(x, "s_suppkey", ["acctbal", "nation"], 1)


@query("""SELECT event_id, list_sort([{'v': -value, 'k': 'value'}, {'v': -(props->>'$.k')::DOUBLE, 'k': 'k'}])[1].k AS top_dim FROM events""")
def o6_top_of_map(spark, d):
    from lattiq.operators.outliers import top_of_map

    dims = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.from_json("props", "k double").k)
    return table(spark, d, "events").select("event_id", top_of_map(dims, 1)[0]["key"].alias("top_dim"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o8_truncate(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey))::BIGINT AS place FROM orders QUALIFY place <= 100")
def o11_newest_first(spark, d):
    top = table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    packed = top.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey"))).alias("all"))  # the 100 rows of the limit
    return packed.select(F.posexplode("all").alias("p", "x")).select(F.col("x.o_orderkey").alias("o_orderkey"), (F.col("p") + 1).cast("long").alias("place"))


@query("""SELECT uid, min(src) AS first_source, count(*) AS copies FROM (SELECT c_nationkey AS uid, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier UNION ALL SELECT n_nationkey, 'n' FROM nation) GROUP BY 1""")
def u2_union_distinct(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("uid"), F.lit(s).alias("src")) for t, c, s in (("customer", "c_nationkey", "c"), ("supplier", "s_nationkey", "s"), ("nation", "n_nationkey", "n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("uid").agg(F.min("src").alias("first_source"), F.count(F.lit(1)).alias("copies"))


@query("SELECT p_partkey, copy FROM part, range(4) t(copy) WHERE copy = 0 OR p_type = 'PROMO'")
def u3_oversample(spark, d):
    from lattiq.operators.sequences import oversample

    return oversample(table(spark, d, "part").select("p_partkey", "p_type"), F.col("p_type") == "PROMO", 4).select("p_partkey", F.col("copy").cast("long").alias("copy"))


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier")
def u4_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def u5_difference(spark, d):
    busy = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").subtract(busy)
