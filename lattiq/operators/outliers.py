"""Anomalies: extremes, cluster outliers, explanations, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq.operators.selection import percentiles
from lattiq.operators.stats import dominant, long_form
from lattiq.session import materialize

PRIORITY = {"multi_dim": 0, "one_of_n": 1, "high_qe": 1, "numeric": 2, "global_extreme": 3, "categorical": 4}


def _reason(kind: str) -> Column:
    return F.format_string(f"%s {kind}: %.4f", "feature", "value")


def global_extremes(df: DataFrame, id_col: str, cols: list[str], threshold: float = 2.5, flag_constant: bool = False) -> DataFrame:
    """Per sample: reasons it is far from a feature's mean or is its minimum or maximum."""
    long = long_form(df, [id_col], cols)
    stats = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = long.join(F.broadcast(stats), "feature")  # one row a feature
    spread = F.lit(True) if flag_constant else F.col("lo") < F.col("hi")
    found = F.array_compact(
        F.array(
            F.when(F.abs(F.col("value") - F.col("mu")) > threshold * F.col("sd"), _reason("outlier")),
            F.when(spread & (F.col("value") == F.col("lo")), _reason("minimum")),
            F.when(spread & (F.col("value") == F.col("hi")), _reason("maximum")),
        )
    )
    return x.select(id_col, F.explode(found).alias("reason")).groupBy(id_col).agg(F.array_sort(F.collect_list("reason")).alias("reasons"))


def local_outliers(df: DataFrame, id_col: str, cluster: str, cols: list[str], threshold: float = 2.5, least: int = 3) -> DataFrame:
    """Per sample and feature: deviation from its cluster's mean beyond *threshold* deviations.

    Cluster statistics are aggregated first and joined back, so a large cluster is no
    single task's.
    """
    long = long_form(df, [id_col, cluster], cols)
    stats = long.groupBy(cluster, "feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("sd") > 0))
    x = long.join(stats, [cluster, "feature"])
    z = (F.col("value") - F.col("mu")) / F.col("sd")
    return x.where(F.abs(z) > threshold).select(id_col, cluster, "feature", "value", F.round(z, 4).alias("z"))


def local_kinds(found: DataFrame, id_col: str) -> DataFrame:
    """numeric, or multi_dim where a sample is far in several features."""
    g = found.groupBy(id_col).agg(F.count_distinct("feature").alias("n_dims"), F.max(F.abs("z")).alias("max_z"))
    return g.withColumn("kind", F.when(F.col("n_dims") > 1, "multi_dim").otherwise("numeric"))


def categorical_minority(df: DataFrame, cluster: str, col: str, purity: float = 0.85) -> DataFrame:
    """Clusters that one category dominates while others occur."""
    top = dominant(df, cluster, col).where((F.col("purity") >= purity) & (F.col("purity") < 1))
    rest = df.join(top, cluster).where(F.col(col) != F.col("dominant")).groupBy(cluster, "dominant", "purity").agg(F.count(F.lit(1)).alias("minority"), F.array_join(F.array_sort(F.collect_set(col)), ",").alias("others"))
    return rest.withColumn("sample_id", F.concat(F.lit("cluster:"), F.col(cluster).cast("string")))


def one_of_n(df: DataFrame, id_col: str, cluster: str, cols: list[str], least: int = 5, ratio: float = 3.0) -> DataFrame:
    """The farthest row of a cluster, where it is *ratio* times as far from the centre as the median row."""
    centre = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_{c}") for c in cols], *[F.count(c).alias(f"_n_{c}") for c in cols]).where(F.col("n") >= least)
    x = df.join(centre, cluster)
    gap = sum((F.when(F.col(f"_n_{c}") == F.col("n"), (F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}"))).otherwise(0.0) for c in cols), F.lit(0.0))
    d = x.select(cluster, id_col, F.round(F.sqrt(gap), 9).alias("dist"))
    median = percentiles(d, [cluster], "dist", [0.5]).select(F.col(cluster).alias("_c"), F.col("q")[0].alias("median"))
    g = d.groupBy(cluster).agg(F.min_by(F.struct(F.col(id_col).alias("id"), "dist"), F.struct(-F.col("dist"), F.col(id_col))).alias("far"))
    g = g.join(median, F.col(cluster) == F.col("_c"))
    return g.where((F.col("median") > 0) & (F.col("far.dist") / F.col("median") >= ratio)).select(cluster, F.col("far.id").alias(id_col), F.round(F.col("far.dist") / F.col("median"), 4).alias("ratio"))


def high_qe(assigned: DataFrame, id_col: str, local: DataFrame | None = None, factor: float = 2.5) -> DataFrame:
    """Rows whose error is above *factor* times the median, but for those found locally; with their top feature.

    The errors are written once, as the median takes several passes over them.
    """
    middle = percentiles(materialize(assigned.select("qe"), "errors"), [], "qe", [0.5]).select(F.col("q")[0].alias("_m"))
    x = assigned.join(F.broadcast(middle)).where(F.col("qe") > factor * F.col("_m"))  # one row
    if local is not None:
        x = x.join(local.select(id_col), id_col, "left_anti")
    return x.select(id_col, "qe", F.round(F.col("qe") / F.col("_m"), 4).alias("ratio"), top_of_map(F.col("qe_dims"), 1)[0]["key"].alias("top_dim"))


def top_of_map(dims: Column, n: int) -> Column:
    """The *n* entries of a map with the largest values; ties by key."""
    return F.slice(F.transform(F.array_sort(F.transform(F.map_entries(dims), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")))), lambda e: F.struct(e["key"].alias("key"), (-e["neg"]).alias("value"))), 1, n)


def top_features(df: DataFrame, id_col: str, cols: list[str], n: int = 5) -> DataFrame:
    """Features farthest from the global mean, high or low."""
    long = long_form(df, [id_col], cols)
    stats = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd")).where("sd > 0")
    x = long.join(F.broadcast(stats), "feature").select(id_col, "feature", F.round((F.col("value") - F.col("mu")) / F.col("sd"), 3).alias("z"))  # one row a feature
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("z")), "feature")
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(id_col, "feature", "z", F.when(F.col("z") > 0, "high").otherwise("low").alias("direction"))


def rank_anomalies(found: DataFrame, id_col: str, limit: int = 20) -> DataFrame:
    """Merge findings (id, kind, n_dims, qe, ratio, reason) by sample and keep the strongest *limit*."""
    order = F.create_map(*[F.lit(v) for k, p in PRIORITY.items() for v in (k, p)])
    x = found.withColumn("priority", order[F.col("kind")])
    g = x.groupBy(id_col).agg(
        F.min(F.struct("priority", "kind")).alias("best"), F.max(F.coalesce("n_dims", F.lit(0))).alias("n_dims"), F.max(F.coalesce("qe", F.lit(0.0))).alias("qe"), F.max(F.coalesce("ratio", F.lit(0.0))).alias("ratio"), F.array_sort(F.collect_set("reason")).alias("reasons")
    )
    g = g.select(id_col, F.col("best.kind").alias("kind"), F.col("best.priority").alias("priority"), "n_dims", "qe", "ratio", "reasons")
    return g.orderBy("priority", F.desc("n_dims"), F.desc("qe"), F.desc("ratio"), id_col).limit(limit)


def enrich_extremes(extremes: DataFrame, assigned: DataFrame, id_col: str) -> DataFrame:
    """Extremes without reasons about the id itself, with their neuron."""
    x = extremes.withColumn("reasons", F.filter("reasons", lambda r: ~F.contains(r, F.lit(id_col)))).where(F.size("reasons") > 0)
    return x.join(assigned.select(id_col, "bmu_key", "qe"), id_col)


def anomaly_records(rows: DataFrame, id_col: str, cols: list[str], stats: DataFrame) -> DataFrame:
    """Each anomaly's values against the mean: delta, delta in percent, and a flag."""
    long = long_form(rows, [id_col], cols).join(F.broadcast(stats), "feature")  # one row a feature
    delta = F.col("value") - F.col("mean")
    pct = F.when(F.col("mean") != 0, delta / F.abs("mean") * 100)
    flag = F.when(F.col("value") == F.col("min"), "min").when(F.col("value") == F.col("max"), "max").when(F.abs(pct) >= 50, "strong").when(F.abs(pct) >= 20, "moderate")
    return long.select(id_col, "feature", "value", F.round(delta, 4).alias("delta"), F.round(pct, 2).alias("delta_pct"), flag.alias("flag"))


def detection_score(found: DataFrame, truth: DataFrame, id_col: str, label: str) -> DataFrame:
    """Precision of the found ids, and recall of each true class."""
    hits = truth.join(found.select(id_col).distinct().withColumn("_hit", F.lit(1)), id_col, "left")
    by = hits.where(F.col(label) != 0).groupBy(label).agg(F.count(F.lit(1)).alias("injected"), F.count("_hit").alias("found"))
    all_ = hits.agg(F.count("_hit").alias("listed"), F.count_if(F.col("_hit").isNotNull() & (F.col(label) != 0)).alias("true"))
    return by.join(F.broadcast(all_)).select(label, "injected", "found", F.round(F.col("found") / F.col("injected"), 6).alias("recall"), F.round(F.try_divide("true", "listed"), 6).alias("precision"))  # one row
