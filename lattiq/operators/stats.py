"""Aggregates: global and per-cluster statistics, purity, coverage, metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq.operators.selection import percentiles


def long_form(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """(ids, feature, value) with one row a cell; nulls are left out."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(ids, cols, "feature", "value").where("value IS NOT NULL")


def global_stats(df: DataFrame, cols: list[str], places: int = 4) -> DataFrame:
    """One row a feature: extremes, mean, deviation, exact percentiles."""
    long = long_form(df, [], cols)
    q = percentiles(long, ["feature"], "value", [0.5, 0.25, 0.75, 0.9, 0.95]).withColumnRenamed("q", "_q")
    g = long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).join(q, "feature")
    names = ("median", "p25", "p75", "p90", "p95")
    full = g.select("feature", "min", "max", "mean", "std", *[F.col("_q")[k].alias(n) for k, n in enumerate(names)])
    return full.select("feature", *[F.round(c, places).alias(c) for c in full.columns[1:]])


def category_shares(df: DataFrame, col: str, places: int = 6) -> DataFrame:
    """Normalised frequencies without nulls."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), places))


def cluster_stats(df: DataFrame, cluster: str, cols: list[str], places: int = 4) -> DataFrame:
    """Per cluster and feature: n, mean, median, std (0 for one row), min, max."""
    long = long_form(df, [cluster], cols)
    g = long.groupBy(cluster, "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), places).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), places).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = percentiles(long, [cluster, "feature"], "value", [0.5]).select(F.col(cluster).alias("_c"), F.col("feature").alias("_f"), F.round(F.col("q")[0], places).alias("median"))
    both = g.join(q, g[cluster].eqNullSafe(q["_c"]) & (g["feature"] == q["_f"]))
    return both.select(cluster, "feature", "n", "mean", "median", "std", "min", "max")


def dominant(df: DataFrame, cluster: str, col: str) -> DataFrame:
    """Most frequent category of each cluster (ties: the smallest) and its share."""
    counts = df.where(F.col(col).isNotNull()).groupBy(cluster, col).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(cluster).agg(F.min_by(F.struct(F.col(col).alias("c"), "n"), F.struct(-F.col("n"), F.col(col))).alias("t"), F.sum("n").alias("size"))
    return top.select(cluster, F.col("t.c").alias("dominant"), F.col("size"), F.round(F.col("t.n") / F.col("size"), 6).alias("purity"))


def category_counts(df: DataFrame, cluster: str, col: str) -> DataFrame:
    """Counts for every pair of a cluster and a category seen anywhere; absent pairs are zero."""
    counts = df.groupBy(cluster, F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    frame = counts.select(cluster).distinct().join(counts.select("category").distinct())  # distinct values of an aggregate
    return frame.join(counts, [cluster, "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def deviation_from_global(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(cluster mean - global mean) / global deviation, to three places; a flat feature gives none."""
    long = long_form(df, [cluster], cols)
    total = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    own = long.groupBy(cluster, "feature").agg(F.avg("value").alias("m"))
    return own.join(F.broadcast(total), "feature").where("sigma > 0").select(cluster, "feature", (F.round((F.col("m") - F.col("mu")) / F.col("sigma"), 3) + 0.0).alias("z"))  # one row a feature


def cluster_ids(df: DataFrame, cluster: str, id_col: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.sort_array(F.collect_list(id_col)).alias("sample_ids"), F.count(F.lit(1)).alias("sample_count"))


def gini(values: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Gini index from grouped sizes: equal values are counted, ranked and summed together."""
    keys = keys or []
    counts = values.groupBy(*keys, F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the positions of c equal values are before+1 .. before+c
    weighted = counts.withColumn("ix", F.col("x") * (F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2))
    agg = (weighted.groupBy(*keys) if keys else weighted.groupBy()).agg(F.sum("ix").alias("ix"), F.sum(F.col("x") * F.col("c")).alias("sx"), F.sum("c").alias("n"))
    return agg.select(*keys, F.round(F.when(F.col("sx") > 0, 2 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0), 6).alias("gini"))


def map_dimension_means(df: DataFrame, col: str) -> DataFrame:
    """Mean and maximum of each key of a map column; null values are skipped."""
    one = df.select(F.explode(col).alias("dimension", "value")).where("value IS NOT NULL")
    return one.groupBy("dimension").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def coverage_metrics(counts: DataFrame, col: str) -> DataFrame:
    """How often samples were visited: rate, spread, quantiles, never-visited share, the Poisson expectation, Gini."""
    q = F.percentile(col, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    one = counts.agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("rate"), F.stddev_pop(col).alias("std"), q.alias("_q"), F.avg((F.col(col) == 0).cast("double")).alias("never"))
    one = one.join(F.broadcast(gini(counts, col)))  # one row each
    return one.select(
        "n", *[F.round(c, 6).alias(c) for c in ("rate", "std", "never")], *[F.round(F.col("_q")[k], 6).alias(n) for k, n in enumerate(("p05", "p50", "p95"))], F.round(F.exp(-F.col("rate")), 6).alias("never_poisson"), "gini"
    )


def quantile_bins(df: DataFrame, col: str, hits: str, bins: int = 10) -> DataFrame:
    """Mean hits and never-hit share in quantile bins of a feature; a value on an edge is in the upper bin."""
    edges = percentiles(df, [], col, [k / bins for k in range(1, bins)]).select(F.col("q").alias("_e"))
    placed = df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col(col))))  # one row
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hits), 6).alias("mean_hits"), F.round(F.avg((F.col(hits) == 0).cast("double")), 6).alias("never"))


def regression_metrics(df: DataFrame, y: Column, p: Column, keys: list[str] | None = None) -> DataFrame:
    e = df.select(*(keys or []), y.cast("double").alias("y"), p.cast("double").alias("p"))
    agg = e.groupBy(*keys) if keys else e.groupBy()
    err = F.col("y") - F.col("p")
    pct = F.when(F.col("y") != 0, F.abs(err / F.col("y")) * 100)
    out = agg.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.sum(err * err).alias("_sse"), F.var_pop("y").alias("_v"), F.avg(pct).alias("mean_pct"), F.percentile(pct, 0.5).alias("median_pct"))
    r2 = F.when(F.col("_v") > 0, 1 - F.col("_sse") / (F.col("n") * F.col("_v")))
    return out.select(*(keys or []), "n", *[F.round(c, 5).alias(c) for c in ("mae", "mse", "mean_pct", "median_pct")], F.round(F.sqrt("mse"), 5).alias("rmse"), F.round(r2, 5).alias("r2"))


def classification_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1; undefined ones are zero."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    c = c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall")], F.round(f1, 6).alias("f1"))


def summary_by(df: DataFrame, keys: list[str], cols: list[str], places: int = 4) -> DataFrame:
    """Per key and metric: n, mean, median, population deviation, extremes and quartiles."""
    long = long_form(df, keys, cols).withColumnRenamed("feature", "metric")
    own = [*keys, "metric"]
    g = long.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = percentiles(long, own, "value", [0.25, 0.5, 0.75]).select(*[F.col(k).alias(f"_{k}") for k in own], F.col("q").alias("_q"))
    g = g.join(q, reduce(lambda a, b: a & b, [g[k].eqNullSafe(q[f"_{k}"]) for k in own]))
    return g.select(*keys, "metric", "n", *[F.round(c, places).alias(c) for c in ("mean", "std", "min", "max")], *[F.round(F.col("_q")[k], places).alias(n) for k, n in enumerate(("p25", "median", "p75"))])
