"""Queries: preparation ladders, feature tables, experiment arms and advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lattiq.operators import studies as S
from lattiq.plans.prepare import PART_GAPS, part_with_gaps
from lattiq.plans.registry import query
from lattiq.session import table

SCHEMA = {"p_type": ["ECONOMY", "PROMO", "SMALL"], "p_brand": ["Brand#1", "Brand#2", "Brand#4"]}


@query(f"""WITH {PART_GAPS}, f AS (SELECT p_partkey, 'part ' || p_partkey AS nm, coalesce(p_brand, '') AS b, coalesce(p_size, (SELECT quantile_cont(p_size::DOUBLE, 0.5) FROM part_gaps))::DOUBLE AS s, (p_brand IS NULL)::INTEGER + (p_size IS NULL)::INTEGER AS gaps FROM part_gaps),
e AS (SELECT p_partkey, gaps, s, dense_rank() OVER (ORDER BY nm) - 1.0::DOUBLE AS nm, dense_rank() OVER (ORDER BY b) - 1.0::DOUBLE AS b FROM f),
n AS (SELECT p_partkey, gaps, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS s, round(nm / max(nm) OVER (), 6) AS nm, round(b / max(b) OVER (), 6) AS b FROM e)
SELECT 'full' AS strategy, p_partkey, gaps AS masked, NULL::DOUBLE AS p_name, b AS p_brand, s AS p_size FROM n UNION ALL SELECT 'scale-only', p_partkey, 0, nm, b, s FROM n UNION ALL SELECT 'none', p_partkey, 0, nm, b, s FROM e""")
def p9_strategy_ladder(spark, d):
    rows = part_with_gaps(spark, d).select("p_partkey", F.concat(F.lit("part "), "p_partkey").alias("p_name"), "p_brand", "p_size")
    out = []
    for s in S.STRATEGIES:
        features, mask = S.prepare_by_strategy(rows, "p_partkey", s)
        masked = sum((F.col(c).cast("int") for c in mask.columns[1:]), F.lit(0))
        out.append(features.join(mask.select("p_partkey", masked.alias("masked")), "p_partkey").withColumn("strategy", F.lit(s)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    return both.select("strategy", "p_partkey", "masked", *[F.round(c, 6).alias(c) for c in ("p_name", "p_brand", "p_size")])


def results(spark, d):
    x = table(spark, d, "part")
    return x.select(F.concat(F.lit("d"), F.col("p_size") % 5).alias("dataset_name"), "p_partkey", "p_type", "p_brand", F.nullif("p_size", F.lit(7)).alias("size"), (F.col("p_partkey") % 9 == 0).alias("is_penalized"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_retailprice")).alias("mqe"))


_R = """r AS (SELECT 'd' || (p_size % 5) AS dataset_name, p_partkey, p_type, p_brand, NULLIF(p_size, 7)::DOUBLE AS size, CASE WHEN p_partkey % 8 <> 0 THEN p_retailprice END AS mqe FROM part
 WHERE p_partkey % 9 <> 0 AND p_type IN ('ECONOMY', 'PROMO', 'SMALL') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#4'))"""


@query(f"""WITH {_R} SELECT dataset_name, p_partkey::DOUBLE AS p_partkey, size, {', '.join(f"({c} = '{v}')::INTEGER AS \"{c}_{v}\"" for c, vs in SCHEMA.items() for v in vs)}, mqe FROM r WHERE size IS NOT NULL AND mqe IS NOT NULL""")
def p14_feature_table(spark, d):
    return S.feature_table(results(spark, d), ["p_partkey", "size"], SCHEMA, ["mqe"])


@query(f"""WITH {_R} SELECT count(*) FILTER (size IS NOT NULL AND mqe IS NOT NULL) AS num_samples, count(*) FILTER (size IS NULL OR mqe IS NULL) AS dropped_rows, count(DISTINCT dataset_name) AS datasets, 8 AS num_features, 1 AS num_targets,
 ['p_partkey', 'size', 'p_type_ECONOMY', 'p_type_PROMO', 'p_type_SMALL', 'p_brand_Brand#1', 'p_brand_Brand#2', 'p_brand_Brand#4'] AS feature_columns FROM r""")
def p14_feature_metadata(spark, d):
    return S.feature_metadata(results(spark, d), ["p_partkey", "size"], SCHEMA, ["mqe"])


@query("""WITH s AS (SELECT c_nationkey AS dataset, count(*) AS samples FROM customer GROUP BY 1)
SELECT dataset, samples, 'det-e' || b AS arm, 'det' AS regime, b AS budget, round((b + 0.5::DOUBLE) / samples, 9) AS epoch_multiplier, 100.0::DOUBLE AS start_percent, 100.0::DOUBLE AS end_percent, 'static' AS growth FROM s, unnest([3, 10, 30, 100, 300, 1000]) t(b)
UNION ALL SELECT dataset, samples, 'stoch-em' || b, 'stoch', b, b::DOUBLE, 0.01, 0.01, 'static' FROM s, unnest([1, 3, 10, 30, 100, 300, 1000]) t(b)
UNION ALL SELECT dataset, samples, 'hyb-b' || b, 'hyb', b, round((round(b * 100 / 3.0::DOUBLE) + 0.5::DOUBLE) / samples, 9), 1.0, 5.0, 'linear-growth' FROM s, unnest([3, 10, 30, 100, 300, 1000]) t(b)""")
def b12_arms(spark, d):
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("dataset")).agg(F.count(F.lit(1)).alias("samples"))
    return S.arms(sizes, "samples").withColumn("epoch_multiplier", F.round("epoch_multiplier", 9))


@query("""WITH r AS (SELECT l_returnflag AS dataset, ['det', 'stoch', 'hyb'][l_linenumber % 3 + 1] AS regime, [3, 10, 30, 100][(l_suppkey % 4)::INTEGER + 1] AS budget, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem WHERE l_orderkey % 11 <> 0),
l AS (SELECT dataset, regime, budget, 'quantity' AS metric, q AS v FROM r UNION ALL SELECT dataset, regime, budget, 'price', p FROM r),
m AS (SELECT dataset, regime, budget, metric, count(*) AS n, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75 FROM l GROUP BY 1, 2, 3, 4),
g AS (SELECT *, (median - lead(median) OVER w) / median AS g FROM m WINDOW w AS (PARTITION BY dataset, regime, metric ORDER BY budget))
SELECT dataset, regime, budget, metric, n, p25, median, p75, round(g, 6) AS gain, coalesce(max(g) OVER (PARTITION BY dataset, regime, metric ORDER BY budget ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < 0.02, true) AS saturated FROM g""")
def a27_arm_quantiles(spark, d):
    """Line items as runs of arms, told apart by the names of their folders; every 11th order is of a foreign folder."""
    regime, budget = F.array(F.lit("det-e"), F.lit("stoch-em"), F.lit("hyb-b")), F.array(*map(F.lit, ("3", "10", "30", "100")))
    name = F.concat(F.lit("arm_"), F.get(regime, F.col("l_linenumber") % 3), F.get(budget, (F.col("l_suppkey") % 4).cast("int")))
    runs = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_orderkey") % 11 == 0, "baseline").otherwise(name).alias("folder"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return S.arm_report(runs, "l_returnflag", "folder", ["quantity", "price"])


@query("""WITH x AS (SELECT p_partkey // 2 AS uid, p_partkey % 10 = 0 AS flag, p_partkey % 10 = 0 OR p_size > 40 AS pen, p_retailprice / 450 AS ratio FROM part), s AS (SELECT count(*) FILTER (flag) AS f, count(*) FILTER (flag AND pen) AS h, count(ratio) AS k, count(*) FILTER (ratio >= 2) AS w FROM x),
g AS (SELECT s_nationkey % 5 AS gen, count(*) FILTER (s_acctbal / 5000 < 1) AS good FROM supplier GROUP BY 1), e AS (SELECT max(good) AS peak, arg_max(good, gen) AS final FROM g),
t AS (SELECT uid, count(*) AS n, min(ratio) < max(ratio) AS d FROM x GROUP BY 1 HAVING count(*) > 1)
SELECT 'flag_always_penalised' AS rule, h AS figure, f AS out_of FROM s WHERE f > 0 AND h >= 0.95 * f UNION ALL SELECT 'high_penalty_rate', w, k FROM s WHERE w > 0.5 * k
UNION ALL SELECT 'archive_regression', final, peak FROM e WHERE peak > final UNION ALL SELECT CASE WHEN count(*) FILTER (d) > 0 THEN 'nondeterministic' ELSE 'duplicates' END, CASE WHEN count(*) FILTER (d) > 0 THEN count(*) FILTER (d) ELSE sum(n - 1) END::BIGINT, count(*) FROM t HAVING count(*) > 0""")
def e19_advice(spark, d):
    p = table(spark, d, "part").select(F.expr("p_partkey div 2").alias("uid"), (F.col("p_partkey") % 10 == 0).alias("flag"), ((F.col("p_partkey") % 10 == 0) | (F.col("p_size") > 40)).alias("pen"), (F.col("p_retailprice") / 450).alias("ratio"))
    g = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("generation"), (F.col("s_acctbal") / 5000).alias("ratio"))
    return S.advice(p, g, "uid", "flag", "pen", "ratio", ["ratio"])
