"""Queries: sources, profiling, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import profile as P
from lattiq.plans.registry import query
from lattiq.session import table

GAPS = "NULLIF(p_size, 7)"


def part_with_gaps(spark, d):
    """part with missing values: size 7 and brand 3 count as missing."""
    return table(spark, d, "part").withColumns({"p_size": F.nullif("p_size", F.lit(7)), "p_brand": F.nullif("p_brand", F.lit("Brand#3"))})


PART_GAPS = "part_gaps AS (SELECT p_partkey, p_name, NULLIF(p_brand, 'Brand#3') AS p_brand, p_type, NULLIF(p_size, 7) AS p_size, p_retailprice FROM part)"


@query("""
SELECT c AS column, u AS nunique, round(u / n, 6) AS nunique_ratio, b AS base_type,
       b = 'text' AND round(u / n, 6) > 0.2 AND c <> 'p_partkey' AS is_noise,
       u <= 30 AND NOT (b = 'text' AND round(u / n, 6) > 0.2) AND c <> 'p_partkey' AS is_categorical,
       CASE WHEN c = 'p_partkey' THEN 'primary_id' WHEN b = 'text' AND round(u / n, 6) > 0.2 THEN 'ignored' ELSE 'used' END AS status
FROM (SELECT count(*)::DOUBLE AS n FROM part), (
  SELECT 'p_partkey' AS c, count(DISTINCT p_partkey) AS u, 'numeric' AS b FROM part UNION ALL
  SELECT 'p_name', count(DISTINCT p_name), 'text' FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), 'text' FROM part UNION ALL
  SELECT 'p_type', count(DISTINCT p_type), 'text' FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size), 'numeric' FROM part UNION ALL
  SELECT 'p_retailprice', count(DISTINCT p_retailprice), 'numeric' FROM part)""")
def p1_profile_columns(spark, d):
    return P.profile_columns(table(spark, d, "part"), "p_partkey")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def p2_drop_noise_columns(spark, d):
    df = table(spark, d, "customer").drop("c_nationkey")
    used = [r["column"] for r in P.profile_columns(df, "c_custkey").where("NOT is_noise").select("column").collect()]
    return df.select(*[c for c in df.columns if c in used])


@query(f"WITH {PART_GAPS} SELECT p_partkey, TRUE AS m_p_partkey, p_brand IS NULL AS m_p_brand, p_size IS NULL AS m_p_size FROM part_gaps")
def p3_ignore_mask(spark, d):
    return P.ignore_mask(part_with_gaps(spark, d), ["p_partkey", "p_brand", "p_size"], "p_partkey")


@query(f"""WITH {PART_GAPS}
SELECT p_partkey, coalesce(p_brand, '') AS p_brand, coalesce(p_size, (SELECT quantile_cont(p_size::DOUBLE, 0.5) FROM part_gaps))::DOUBLE AS p_size FROM part_gaps""")
def p4_fill_missing(spark, d):
    return P.fill_missing(part_with_gaps(spark, d).select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"])


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS p_type, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS p_brand FROM part")
def p5_label_encode(spark, d):
    return P.encode_labels(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"])


@query("""SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)), 6) AS o_totalprice, 0.0::DOUBLE AS k FROM orders""")
def p6_min_max_scale(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(5).alias("k"))
    return P.min_max_scale(df, ["o_totalprice", "k"]).withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("SELECT p_partkey, p_size::DOUBLE AS p_size, 0.0::DOUBLE AS nothing FROM part")
def p7_zero_masked_columns(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.lit(None).cast("double").alias("nothing"))
    return P.zero_masked_columns(df, ["p_size", "nothing"])


@query(f"""WITH {PART_GAPS}, a AS (SELECT count(*) AS n, count(*) FILTER (p_size IS NULL) + count(*) FILTER (p_brand IS NULL) AS miss, count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS t FROM part_gaps)
SELECT n AS ds_n_samples, 4 AS ds_n_dims, 2 AS ds_n_numeric, 2 AS ds_n_categorical, 1 AS ds_n_ignored, miss::BIGINT AS ds_n_missing_before_fill,
  round(miss / (n * 4)::DOUBLE, 6) AS ds_missing_ratio, 0.5::DOUBLE AS ds_categorical_ratio, greatest(b, t) AS ds_max_cardinality, round((b + t) / 2.0::DOUBLE, 6) AS ds_mean_cardinality, 'full' AS ds_preprocess_strategy FROM a""")
def p8_dataset_stats(spark, d):
    return P.dataset_stats(part_with_gaps(spark, d), ["p_size", "p_retailprice"], ["p_brand", "p_type"], ["p_name"])


@query("SELECT 'o_orderkey' AS primary_id")
def p10_infer_primary_id(spark, d):
    df = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey")
    return spark.createDataFrame([(P.infer_primary_id(P.profile_columns(df), df.columns),)], "primary_id string")


@query("""SELECT 'p_size' AS column, count(DISTINCT p_size) AS nunique, CASE WHEN count(DISTINCT p_size) <= 50 THEN 'label' ELSE 'parameter' END AS role FROM part
UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), 'parameter' FROM part""")
def p11_split_groundtruth(spark, d):
    return P.split_groundtruth(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey")


@query("""SELECT p_partkey, p_type FROM (SELECT p_partkey, NULLIF(p_size, 7) AS s, p_type FROM part) WHERE s IS NOT NULL AND p_type <> 'PROMO' AND s < 45""")
def p12_filter_individuals(spark, d):
    df = part_with_gaps(spark, d).where((F.col("p_type") != "PROMO") & (F.col("p_size") < 45))
    return df.dropna(subset=["p_size"]).select("p_partkey", "p_type")


@query("""SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS status_F, (o_orderstatus = 'O')::INTEGER AS status_O, (o_orderstatus = 'X')::INTEGER AS status_X FROM orders""")
def p13_one_hot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *P.one_hot(F.col("o_orderstatus"), "status", ["F", "O", "X"]))


@query("""WITH m AS (SELECT s_suppkey, s_acctbal AS a, s_nationkey::DOUBLE AS b, s_suppkey::DOUBLE AS c FROM supplier), s AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc FROM m)
SELECT s_suppkey, round(greatest(0, least(1, 0.5::DOUBLE * (1 - (a - la) / (ha - la)) + 0.3::DOUBLE * (1 - (b - lb) / (hb - lb)) + 0.2::DOUBLE * (1 - (c - lc) / (hc - lc)))), 6) AS quality FROM m, s""")
def p15_quality_score(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"), F.col("s_suppkey").cast("double").alias("c"))
    return P.quality_score(df, "a", "b", "c").select("s_suppkey", "quality")


@query("""WITH x AS (SELECT l_suppkey, round(avg(l_discount) * 5, 9) AS te, round(avg(l_tax) * 4, 9) AS dead FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN dead > 0.30 THEN 0.1 WHEN te > 0.50 THEN 0.1 WHEN dead < 0.05 AND te < 0.10 THEN 0.9 END::DOUBLE AS label,
 CASE WHEN dead > 0.30 THEN 'auto_dead' WHEN te > 0.50 THEN 'auto_te' WHEN dead < 0.05 AND te < 0.10 THEN 'auto_good' END AS source FROM x""")
def p16_rule_labels(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount") * 5, 9).alias("te"), F.round(F.avg("l_tax") * 4, 9).alias("dead"))
    label, source = P.rule_label(F.col("te"), F.col("dead"))
    return x.select("l_suppkey", label.alias("label"), source.alias("source"))


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, CASE WHEN abs(l_discount * 10 - 0.5) >= 0.15 THEN l_discount * 10 END AS pseudo FROM lineitem")
def p17_pseudo_labels(spark, d):
    p = F.col("l_discount") * 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"), P.pseudo_label(p).alias("pseudo"))


@query("""SELECT p_partkey, greatest(p_size / 50.0::DOUBLE, p_retailprice / 2000) AS lr_start, least(p_size / 50.0::DOUBLE, p_retailprice / 2000) AS lr_end,
 greatest(0.1, p_size / 10.0::DOUBLE - 1) AS epoch_multiplier, CASE WHEN p_type = 'PROMO' THEN 0.0 ELSE greatest(1.0, p_size / 20.0::DOUBLE) END::DOUBLE AS growth_g, greatest(1, p_size - 5) AS num_batches FROM part""")
def p19_repair_config(spark, d):
    from lattiq.operators.pareto import repair_config

    c = table(spark, d, "part").select(
        "p_partkey",
        (F.col("p_size") / 50.0).alias("lr_start"),
        (F.col("p_retailprice") / 2000).alias("lr_end"),
        (F.col("p_size") / 10.0 - 1).alias("epoch_multiplier"),
        (F.col("p_size") / 20.0).alias("growth_g"),
        (F.col("p_size") - 5).alias("num_batches"),
        (F.col("p_type") == "PROMO").alias("all_linear"),
    )
    return repair_config(c).drop("all_linear")


@query(f"WITH {PART_GAPS} SELECT p_partkey, CASE WHEN p_size IS NULL THEN 0.0 ELSE p_size END::DOUBLE AS p_size, p_retailprice FROM part_gaps")
def p20_strip_masked(spark, d):
    from lattiq.operators.som import strip_masked

    df = part_with_gaps(spark, d).select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.lit(None).cast("double").alias("gone"))
    return strip_masked(df, ["p_size", "p_retailprice", "gone"])


@query(f"""WITH {PART_GAPS} SELECT 'p_brand' AS column, count(*) FILTER (p_brand IS NULL) AS missing, count(*) AS rows, FALSE AS always_masked FROM part_gaps
UNION ALL SELECT 'p_size', count(*) FILTER (p_size IS NULL), count(*), FALSE FROM part_gaps""")
def p21_mask_by_column(spark, d):
    df = part_with_gaps(spark, d).select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    return P.mask_summary(df, ["p_brand", "p_size"], "p_partkey")[0]


@query(f"""WITH {PART_GAPS} SELECT p_partkey, (p_brand IS NULL)::INTEGER + (p_size IS NULL)::INTEGER AS missing FROM part_gaps WHERE p_brand IS NULL OR p_size IS NULL ORDER BY 2 DESC, 1 LIMIT 5""")
def o10_most_incomplete_rows(spark, d):
    return P.mask_summary(part_with_gaps(spark, d), ["p_brand", "p_size"], "p_partkey")[1]


@query("""SELECT count(*) AS rows, count(*) - count(s) AS null_sizes, min(s) AS min_size, max(s) AS max_size, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)) AS duplicate_names,
 (SELECT count(*) FROM part ANTI JOIN lineitem ON p_partkey = l_partkey) AS unused_parts FROM (SELECT NULLIF(p_size, 7) AS s FROM part)""")
def p22_data_quality(spark, d):
    df = part_with_gaps(spark, d)
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p_size").isNull()).alias("null_sizes"), F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"))
    twice = df.groupBy("p_name").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_names"))
    unused = df.join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").agg(F.count(F.lit(1)).alias("unused_parts"))
    return base.join(F.broadcast(twice)).join(F.broadcast(unused))  # one row each


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k, try_cast(trim('x' || event_type) AS DOUBLE) AS bad, coalesce(try_cast(CASE WHEN user_id % 3 = 0 THEN '' ELSE value::VARCHAR END AS DOUBLE), -1) AS num FROM events")
def f_tolerant_casts(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.from_json("props", "k int").k.alias("k"),
        scalar.to_double(F.concat(F.lit("x"), "event_type")).alias("bad"),
        scalar.to_double(F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("value").cast("string")), -1.0).alias("num"),
    )


@query("""WITH o AS (SELECT *, CASE WHEN o_totalprice > 400000 THEN 'big' ELSE 'small' END AS f FROM orders)
SELECT f AS source, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY 1""")
def s6_union_with_source(spark, d):
    from lattiq.sources.tables import union_sources

    o = table(spark, d, "orders")
    big, small = o.where("o_totalprice > 400000"), o.where("o_totalprice <= 400000").drop("o_orderpriority")
    return union_sources({"big": big, "small": small}).groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def s8_first_row_per_uid(spark, d):
    from lattiq.operators.windows import keep_first

    return keep_first(table(spark, d, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "value")


@query("""SELECT p_partkey, p_size % 10 AS generation FROM part WHERE p_size % 10 = (SELECT max(p_size % 10) FROM part)""")
def s11_final_front(spark, d):
    from lattiq.operators.windows import last_of_each

    g = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 10).alias("generation"), F.lit(1).alias("run"))
    return last_of_each(g, ["run"], "generation").select("p_partkey", "generation")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(html) AS n_chars FROM pages""")
def s9_regex_parse(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.char_length("html").cast("long").alias("n_chars"))


@query("SELECT p_partkey, p_size < 25 AS is_feasible, p_size * 2 AS map_area, round(1 - p_retailprice / 3000, 6) AS topo_obj FROM part")
def s10_derived_columns(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") < 25).alias("is_feasible"), (F.col("p_size") * 2).alias("map_area"), F.round(1 - F.col("p_retailprice") / 3000, 6).alias("topo_obj"))
