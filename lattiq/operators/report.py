"""Reports on a published run: nine sections of context lines, and the tables of a printed report.

Every part is an aggregate of the run's published tables; only what a report shows of it (the largest
clusters, the strongest anomalies) is joined back to values, so a part has as many rows as its limit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lattiq.operators import engine, outliers, som, stats
from lattiq.operators.grid import Grid, regions
from lattiq.session import materialize

TITLES = ("dataset", "map", "clusters", "anomalies", "anomaly records", "dimensions", "categories", "regions", "missing data")


@dataclass(frozen=True)
class Limits:
    """What a report shows at most of each part."""

    clusters: int = 50
    anomalies: int = 10
    features: int = 3
    categories: int = 30
    dead: int = 15
    regions: int = 10
    incomplete: int = 5

    def __post_init__(self):
        if min(vars(self).values()) < 1:
            raise ValueError("limits are at least 1")


#: A printed report has less room for clusters and more for anomalies.
PRINTED = Limits(clusters=40, anomalies=20)


class RunView:
    """The published tables of a run, and the rows it was made from."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, source: DataFrame):
        known = engine.manifests(spark, root)
        row = None if known is None else known.where(F.col("run_id") == run_id).first()
        if row is None:
            raise LookupError(f"no published run {run_id!r}")
        config = json.loads(row["config"])
        self.id, self.numeric, self.categorical = config["id_col"], list(config["numeric"]), list(config["categorical"])
        self.features, self.grid = [*self.numeric, *self.categorical], Grid(*config["grid"])
        self.threshold, self.folder, self.spark = config["threshold"], row["folder"], spark
        self.source = source.select(self.id, *self.features)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def codebook(self) -> som.Codebook:
        """The trained weights; a codebook is bounded by its size."""
        rows = self.table("codebook").orderBy("nid").collect()
        return som.Codebook(self.grid, tuple(self.features), np.array([[r[f"dim_{f}"] for f in self.features] for r in rows]))

    def placed(self) -> DataFrame:
        """The source rows with their neuron."""
        return self.source.join(self.table("assignments").select(self.id, "bmu_key"), self.id)


def _fixed(value: Column, places: int = 4, signed: bool = False) -> Column:
    """A number as text, rounded before it is formatted; an unknown one is n/a."""
    return F.when(value.isNotNull(), F.format_string(f"%{'+' if signed else ''}.{places}f", F.round(value, places) + 0.0)).otherwise("n/a")


def _numbered(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first *limit* rows with their place; the limit comes first, so one task numbers few rows."""
    return df.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def _section(no: int, df: DataFrame, line: Column) -> DataFrame:
    return df.select(F.lit(no).alias("section"), F.col("place").cast("int").alias("place"), line.alias("line"))


def cluster_table(view: RunView, limits: Limits = PRINTED, highlight: float = 1.5) -> DataFrame:
    """(place, bmu_key, sample_count, qe_mean, feature, mean, z, highlighted) of the largest clusters' numeric features."""
    top = _numbered(view.table("clusters"), [F.desc("sample_count"), "bmu_key"], limits.clusters).select("place", "bmu_key", "sample_count", "qe_mean")
    rows = view.placed()
    means = stats.long_form(rows, ["bmu_key"], view.numeric).groupBy("bmu_key", "feature").agg(F.round(F.avg("value"), 4).alias("mean"))
    cells = means.join(F.broadcast(top), "bmu_key").join(stats.deviation_from_global(rows, "bmu_key", view.numeric), ["bmu_key", "feature"], "left")  # top has at most the limit's rows
    return cells.select("place", "bmu_key", "sample_count", "qe_mean", "feature", "mean", "z", (F.abs(F.coalesce("z", F.lit(0.0))) > highlight).alias("highlighted"))


def anomaly_table(view: RunView, limits: Limits = PRINTED) -> DataFrame:
    """(place, id, bmu_key, kind, n_dims, qe, reasons) of the strongest anomalies."""
    local = view.table("local_outliers")
    kinds = outliers.local_kinds(local, view.id).select(view.id, "kind", "n_dims")
    none = F.lit(None).cast("double").alias("ratio")
    qe = view.table("assignments").select(view.id, "bmu_key", "qe")
    near = local.join(kinds, view.id).select(view.id, "kind", "n_dims", F.concat_ws(": ", "feature", F.concat(_fixed(F.col("z"), 2, True), F.lit(" deviations"))).alias("reason"))
    far = view.table("extremes").select(view.id, F.lit("global_extreme").alias("kind"), F.lit(0).cast("long").alias("n_dims"), F.explode("reasons").alias("reason"))
    found = near.unionByName(far).join(qe, view.id).select(view.id, "kind", "n_dims", "qe", none, "reason")
    best = outliers.rank_anomalies(found, view.id, limits.anomalies)
    ranked = _numbered(best, ["priority", F.desc("n_dims"), F.desc("qe"), view.id], limits.anomalies)
    return qe.select(view.id, "bmu_key").join(F.broadcast(ranked), view.id).select("place", view.id, "bmu_key", "kind", "n_dims", "qe", "reasons")  # ranked has at most the limit's rows


def dimension_table(view: RunView) -> DataFrame:
    """Figures of each numeric feature, on the scale of the source."""
    return stats.global_stats(view.source, view.numeric)


def _map_lines(view: RunView, limits: Limits, quality: dict[str, float]) -> DataFrame:
    errors, size = view.table("neuron_errors"), view.grid.size
    held = som.map_quality(view.table("normalized"), view.codebook())
    dead = errors.agg(F.count_if(F.col("hits") == 0).alias("dead"), F.sum("hits").alias("rows"), F.array_sort(F.collect_list(F.when(F.col("hits") == 0, F.col("neuron_key")))).alias("names"))  # neurons, not rows
    one = dead.join(F.broadcast(held))  # one row each
    names = F.when((F.col("dead") > 0) & (F.col("dead") <= limits.dead), F.concat(F.lit(": "), F.array_join("names", ", "))).otherwise("")
    lines = [
        F.lit(f"size: {view.grid.m} x {view.grid.n} {view.grid.topology}"),
        F.concat(F.lit("rows: "), F.coalesce("rows", F.lit(0)).cast("string")),
        F.concat(F.lit(f"neurons: {size}, without rows: "), F.col("dead").cast("string"), F.lit(" ("), _fixed(F.col("dead") * 100 / size, 1), F.lit(" %)"), names),
        F.concat(F.lit("mean error: "), _fixed(F.col("mqe"))),
        F.concat(F.lit("topographic error: "), _fixed(F.col("topographic_error"))),
        *[F.concat(F.lit(f"{name}: "), _fixed(F.lit(float(value)))) for name, value in quality.items()],
    ]
    found = one.select(F.posexplode(F.array(*lines)).alias("place", "line"))
    return _section(2, found.withColumn("place", F.col("place") + 1), F.col("line"))


def _cluster_lines(view: RunView, limits: Limits, cells: DataFrame) -> DataFrame:
    order = F.struct((-F.abs(F.coalesce("z", F.lit(0.0)))).alias("far"), "feature", F.concat(F.col("feature"), F.lit(" "), _fixed(F.col("mean")), F.lit(" (z "), _fixed(F.col("z"), 3, True), F.lit(")")).alias("text"))
    told = cells.groupBy("bmu_key").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, limits.features), lambda s: s["text"]), ", ").alias("features"))
    top = _numbered(view.table("clusters"), [F.desc("sample_count"), "bmu_key"], limits.clusters).join(told, "bmu_key", "left")
    text = F.concat(F.col("bmu_key"), F.lit(": "), F.col("sample_count").cast("string"), F.lit(" rows, error "), _fixed(F.col("qe_mean")))
    if view.categorical:
        shares = view.table("category_shares")
        best = shares.groupBy("bmu_key", "feature").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("c"), (F.max("n") / F.sum("n")).alias("p"))
        mostly = best.groupBy("bmu_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat("feature", F.lit("="), "c", F.lit(" ("), _fixed(F.col("p"), 3), F.lit(")")))), ", ").alias("mostly"))
        top = top.join(mostly, "bmu_key", "left")
        text = F.concat(text, F.when(F.col("mostly").isNotNull(), F.concat(F.lit(", mostly "), F.col("mostly"))).otherwise(""))
    return _section(3, top, F.concat(text, F.when(F.col("features").isNotNull(), F.concat(F.lit("; "), F.col("features"))).otherwise("")))


def _anomaly_lines(view: RunView, ranked: DataFrame) -> DataFrame:
    far, near = view.table("extremes").agg(F.count(F.lit(1)).alias("far")), view.table("local_outliers").agg(F.count_distinct(view.id).alias("near"))
    head = far.join(F.broadcast(near)).select(F.lit(0).alias("place"), F.format_string("global extremes: %d, outliers of a cluster: %d", "far", "near").alias("line"))  # one row each
    text = F.concat(F.col(view.id).cast("string"), F.lit(" ("), "bmu_key", F.lit(", "), "kind", F.lit("): "), F.array_join("reasons", "; "))
    return _section(4, head, F.col("line")).unionByName(_section(4, ranked, text))


def _record_lines(view: RunView, ranked: DataFrame, figures: DataFrame) -> DataFrame:
    rows = view.source.join(F.broadcast(ranked.select(view.id)), view.id)  # as many rows as are reported
    cells = outliers.anomaly_records(rows, view.id, view.numeric, figures)
    text = F.concat(F.col("feature"), F.lit("="), _fixed(F.col("value")), F.lit(" ["), _fixed(F.col("delta"), 4, True), F.lit(", "), _fixed(F.col("delta_pct"), 2, True), F.lit(" %]"), F.when(F.col("flag").isNotNull(), F.concat(F.lit(" "), F.col("flag"))).otherwise(""))
    told = cells.groupBy(view.id).agg(F.array_join(F.array_sort(F.collect_list(text)), " | ").alias("cells"))
    return _section(5, ranked.join(told, view.id), F.concat(F.col(view.id).cast("string"), F.lit(": "), F.col("cells")))


def _dimension_lines(view: RunView) -> DataFrame:
    names = ("min", "max", "mean", "std", "median", "p25", "p75")
    parts = [F.concat(F.lit(f"{c} "), _fixed(F.col(c))) for c in names]
    table = dimension_table(view).withColumn("place", F.array_position(F.array(*map(F.lit, view.numeric)), F.col("feature")))
    return _section(6, table, F.concat(F.col("feature"), F.lit(": "), F.concat_ws(", ", *parts)))


def _category_lines(view: RunView, limits: Limits) -> DataFrame:
    """Shares over all clusters; of each feature the most frequent categories."""
    n = view.table("category_shares").groupBy("feature", "category").agg(F.sum("n").alias("n"))
    whole = n.groupBy("feature").agg(F.sum("n").alias("all"))
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "category")
    top = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limits.categories).join(F.broadcast(whole), "feature")  # one row a feature
    text = F.struct("r", F.concat(F.col("category"), F.lit(" "), _fixed(F.col("n") / F.col("all"))).alias("text"))
    told = top.groupBy("feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda s: s["text"]), ", ").alias("parts"))
    told = told.withColumn("place", F.array_position(F.array(*map(F.lit, view.categorical)), F.col("feature")))
    return _section(7, told, F.concat(F.col("feature"), F.lit(": "), F.col("parts")))


def _region_lines(view: RunView, limits: Limits) -> DataFrame:
    """Connected neurons with the same dominant category of the first categorical feature."""
    shares = view.table("category_shares").where(F.col("feature") == view.categorical[0])
    top = shares.groupBy("bmu_key").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))
    cells = view.grid.neurons(view.spark).join(top, F.col("neuron_key") == F.col("bmu_key")).select("nid", "i", "j", "category")
    found = _numbered(regions(cells, view.grid.edges(view.spark, rook=True), limits.regions), [F.desc("size"), "region"], limits.regions)
    return _section(8, found, F.concat(F.col("category"), F.lit(": "), F.col("size").cast("string"), F.lit(" neurons around "), _fixed(F.col("centre_i"), 2), F.lit(", "), _fixed(F.col("centre_j"), 2)))


def _missing_lines(view: RunView, limits: Limits) -> DataFrame:
    """Cells the run could not see, from its mask; columns without any value are named apart and count for no row."""
    flags = view.table("mask")
    cols = [c for c in view.features if c != view.id]
    seen = flags.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"m_{c}")).alias(c) for c in cols])
    row = seen.first()
    empty = [c for c in cols if row["rows"] and row[c] == row["rows"]]
    rest = [c for c in cols if c not in empty]
    gaps = flags.select(view.id, F.array_compact(F.array(*[F.when(F.col(f"m_{c}"), F.lit(c)) for c in rest])).alias("gaps")).where(F.size("gaps") > 0)
    affected = gaps.agg(F.count(F.lit(1)).alias("n"))
    heads = ([(0, f"without any value: {', '.join(empty)}")] if empty else []) + [(2 + k, f"{c}: {row[c]}") for k, c in enumerate(rest) if row[c]]
    lines = _section(9, view.spark.createDataFrame(heads, "place int, line string"), F.col("line"))
    lines = lines.unionByName(_section(9, affected.withColumn("place", F.lit(1)), F.concat(F.lit("rows with missing values: "), F.col("n").cast("string"), F.lit(f" of {row['rows']}"))))
    worst = _numbered(gaps, [F.desc(F.size("gaps")), view.id], limits.incomplete).withColumn("place", F.col("place") + 2 + len(cols))
    return lines.unionByName(_section(9, worst, F.concat(F.col(view.id).cast("string"), F.lit(" misses "), F.array_join("gaps", ", "))))


def context_lines(view: RunView, description: str | None = None, limits: Limits = Limits(), quality: dict[str, float] | None = None) -> DataFrame:
    """(section, place, line) of all nine sections; *quality* holds further figures of the map by name."""
    text = [x.strip() for x in (description or "").splitlines() if x.strip()] or ["no description; column names are all that is known"]
    out = _section(1, view.spark.createDataFrame(list(enumerate(text, 1)), "place int, line string"), F.col("line"))
    ranked = materialize(anomaly_table(view, limits), "report-anomalies")
    figures = stats.long_form(view.source, [], view.numeric).groupBy("feature").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    parts = [_map_lines(view, limits, quality or {}), _cluster_lines(view, limits, cluster_table(view, limits)), _anomaly_lines(view, ranked), _record_lines(view, ranked, figures), _dimension_lines(view)]
    parts += [_category_lines(view, limits), _region_lines(view, limits)] if view.categorical else []
    for part in [*parts, _missing_lines(view, limits)]:
        out = out.unionByName(part)
    return out


def as_text(lines: DataFrame) -> str:
    """The report as one text; its length is bounded by the limits."""
    out: list[str] = []
    for row in lines.orderBy("section", "place", "line").collect():
        title = f"== {TITLES[row['section'] - 1]} =="
        if title not in out:
            out += ([""] if out else []) + [title]
        out.append(row["line"])
    return "\n".join(out)
