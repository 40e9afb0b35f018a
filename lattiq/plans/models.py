"""Queries: importance of columns, the archive of a search, and results of stored runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattiq.operators import archive, importance
from lattiq.plans.registry import query
from lattiq.plans.search import CAND, DOM, OBJS, candidates
from lattiq.session import scratch_root, table
from lattiq.sources import catalogue

_SHUFFLED = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, r AS repeat, {f} AS v, row_number() OVER (PARTITION BY r ORDER BY md5(id || ':{f}:' || r), id) AS p FROM x, range(3) t(r)" for f in ("a", "b", "c")
)


@query(f"""WITH x AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS a, p_retailprice / 2000 AS b, (p_partkey % 7)::DOUBLE AS c, p_size / 40.0::DOUBLE + p_retailprice / 4000 AS y FROM part), o AS (SELECT *, row_number() OVER (ORDER BY id) AS p FROM x),
s AS ({_SHUFFLED}), e AS (SELECT feature, repeat, avg(pow(y - (1.2::DOUBLE * CASE WHEN feature = 'a' THEN v ELSE a END + 0.4::DOUBLE * CASE WHEN feature = 'b' THEN v ELSE b END), 2)) AS e, avg(pow(y - (1.2::DOUBLE * a + 0.4::DOUBLE * b), 2)) AS b FROM o JOIN s USING (p) GROUP BY 1, 2)
SELECT feature, round(avg(b), 6) AS baseline, round(avg(e - b), 6) + 0.0::DOUBLE AS importance, round(stddev_pop(e - b), 6) AS spread FROM e GROUP BY 1""")
def n11_permutation_importance(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), (F.col("p_partkey") % 7).cast("double").alias("c"), (F.col("p_size") / 40.0 + F.col("p_retailprice") / 4000).alias("y")
    )
    got = importance.permutation_importance(rows, "id", ["a", "b", "c"], "y", lambda x: 1.2 * x["a"] + 0.4 * x["b"])
    return got.select("feature", F.round("baseline", 6).alias("baseline"), (F.round("importance", 6) + 0.0).alias("importance"), F.round("spread", 6).alias("spread"))


@query(f"""WITH {CAND}, g AS (SELECT *, uid % 5 AS gen FROM cand), e AS (SELECT * FROM g q WHERE NOT EXISTS (SELECT 1 FROM g p WHERE p.gen <= q.gen AND {DOM}))
SELECT uid, gen::INTEGER AS entered, (SELECT min(p.gen) FROM g p WHERE p.gen > q.gen AND {DOM})::INTEGER AS retired FROM e q""")
def e15_archive(spark, d):
    rows = candidates(spark, d).withColumn("gen", F.col("uid") % 5)
    return archive.evolve_archive(rows, "gen", "uid", OBJS, "cv").select("uid", "entered", "retired")


def stored_runs(spark, d):
    """Suppliers written as results of runs: a region is a data set, a nation a run, and later runs have one column more."""
    root = f"{scratch_root(spark)}/tree-{uuid.uuid4().hex}"
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("int").alias("nation"))
    for seed in range(3):
        part = s.where(F.col("s_suppkey") % 3 == seed)
        rows = part.select(F.col("s_suppkey").alias("uid"), F.round(F.col("s_acctbal") / 100, 4).alias("mqe"), *([F.col("nation").alias("origin")] if seed else []))
        rows.write.parquet(f"{root}/supply/results/r{seed // 2}/seed_{seed}/results")
        part.groupBy().agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("s_acctbal"), 4).alias("mean")).coalesce(1).write.parquet(f"{root}/supply/results/r{seed // 2}/seed_{seed}/metrics")
    return root


_RUNS = "s AS (SELECT s_suppkey AS uid, round(s_acctbal / 100, 4) AS mqe, (s_suppkey % 3)::INTEGER AS seed, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey::INTEGER END AS origin, s_acctbal FROM supplier)"


@query(f"""WITH {_RUNS}, m AS (SELECT seed, count(*) AS n_rows, round(avg(s_acctbal), 4) AS mean FROM s GROUP BY 1)
SELECT 'supply' AS dataset, 'r' || (seed // 2) AS run, seed, uid, mqe, origin, n_rows, mean FROM s JOIN m USING (seed)""")
def s5_s12_runs_with_metrics(spark, d):
    root = stored_runs(spark, d)
    metrics = catalogue.read_artefact(spark, root, "metrics").drop("_source")
    return catalogue.read_artefact(spark, root, "results").drop("_source").join(metrics, ["dataset", "run", "seed"]).select("dataset", "run", "seed", "uid", "mqe", "origin", "n_rows", "mean")


@query(f"WITH {_RUNS} SELECT 'supply' AS dataset, 'r' || (seed // 2) AS run, seed, artefact, true AS has_files FROM (SELECT DISTINCT seed FROM s), (VALUES ('results'), ('metrics')) t(artefact)")
def s7_run_tree(spark, d):
    listed = catalogue.files(spark, stored_runs(spark, d))
    return listed.groupBy("dataset", "run", "seed", "artefact").agg((F.sum("bytes") > 0).alias("has_files"))
