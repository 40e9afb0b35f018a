"""One call from a table to all tables of a run, published together.

``run`` prepares a table, trains a map, assigns every row, and writes all results below an
attempt folder of their own. A row in the ``manifests`` table, written last, is the commit: readers
find a run only through it, so they see all of its tables or none, and a run that is repeated
replaces its tables at once. Row counts and quality figures are observed while tables are
written, so no table is read a second time for them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from lattiq.operators import outliers, profile, som
from lattiq.operators.grid import Grid
from lattiq.sources.tables import try_read

TABLES = ("column_info", "mask", "normalized", "codebook", "checkpoints", "assignments", "neuron_errors", "clusters", "category_shares", "extremes", "local_outliers")


@dataclass(frozen=True)
class RunConfig:
    id_col: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    grid: tuple[int, int, str] = (8, 8, "hex")
    #: Epochs of batch training; 0 keeps the start.
    epochs: int = 8
    #: "random" by seed, or "lattice".
    start: str = "random"
    seed: int = 42
    #: Deviations from which a value is far from a mean.
    threshold: float = 2.5

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def prepare(df: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """Column figures, the mask of missing cells, and the encoded and scaled features (missing cells stay null)."""
    raw = df.select(config.id_col, *config.features)
    codes = profile.encode_labels(raw, list(config.categorical))
    return {
        "column_info": profile.profile_columns(raw, config.id_col),
        "mask": profile.ignore_mask(raw, config.features, config.id_col),
        "normalized": profile.min_max_scale(codes, config.features),
    }


def analyse(assigned: DataFrame, normalized: DataFrame, raw: DataFrame, cb: som.Codebook, config: RunConfig) -> dict[str, DataFrame]:
    """Clusters, errors, category shares and outliers of assigned rows."""
    extremes = outliers.global_extremes(normalized, config.id_col, config.features, config.threshold)
    placed = normalized.join(assigned.select(config.id_col, "bmu_key"), config.id_col)
    far = outliers.local_outliers(placed, config.id_col, "bmu_key", config.features, config.threshold)
    flag = extremes.select(config.id_col, F.lit(True).alias("is_outlier"))
    cells = F.transform_values("qe_dims", lambda _, v: F.round(v, 6))
    rows = assigned.join(flag, config.id_col, "left").select(config.id_col, "bmu_i", "bmu_j", "bmu_key", F.round("qe", 6).alias("qe"), cells.alias("qe_dims"), F.coalesce("is_outlier", F.lit(False)).alias("is_outlier"))
    per = assigned.groupBy("bmu_key").agg(F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("qe"), 6).alias("qe_mean"), F.round(F.max("qe"), 6).alias("qe_max"))
    shares = raw.join(assigned.select(config.id_col, "bmu_key"), config.id_col)
    long = [shares.select("bmu_key", F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in config.categorical]
    pies = None
    for one in long:
        counted = one.where("category IS NOT NULL").groupBy("bmu_key", "feature", "category").agg(F.count(F.lit(1)).alias("n"))
        pies = counted if pies is None else pies.unionByName(counted)
    out = {"assignments": rows.orderBy(config.id_col), "neuron_errors": som.neuron_report(assigned, cb.grid), "clusters": per, "extremes": extremes, "local_outliers": far}
    return out | ({"category_shares": pies} if pies is not None else {})


def _observed(name: str, columns: list[str]) -> list:
    """What is gathered while a table is written."""
    figures = [F.count(F.lit(1)).alias("rows")]
    if name == "assignments":
        figures += [F.avg("qe").alias("mqe"), F.count_if("is_outlier").alias("outliers")]
    if name == "neuron_errors":
        figures += [F.avg((F.col("hits") == 0).cast("double")).alias("dead_ratio"), F.max("hits").alias("max_hits")]
    return figures


def _write(df: DataFrame, folder: str, name: str) -> dict:
    seen = Observation(name)
    df.observe(seen, *_observed(name, df.columns)).write.parquet(f"{folder}/{name}")
    return seen.get


def run(df: DataFrame, config: RunConfig, root: str, run_id: str) -> dict:
    """Prepare, train, assign, analyse and publish; returns the manifest."""
    spark = df.sparkSession
    profile.validate_input(df, [config.id_col, *config.features])
    folder = f"{root.rstrip('/')}/attempts/{run_id}-{uuid.uuid4().hex}"
    figures: dict[str, dict] = {}

    def publish(name: str, frame: DataFrame) -> DataFrame:
        figures[name] = _write(frame, folder, name)
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    stored = {name: publish(name, frame) for name, frame in prepare(df, config).items()}
    normalized, grid = stored["normalized"], Grid(*config.grid)
    if config.start == "lattice":
        cb, checkpoints = som.Codebook.lattice(grid, config.features), []
    else:
        cb, checkpoints = som.Codebook.random(grid, config.features, config.seed), []
    if config.epochs:
        cb, checkpoints = som.train(normalized, grid, config.features, som.TrainSpec(epochs=config.epochs, seed=config.seed), cb)
    weights = cb.frame(spark).select("nid", F.col("i").alias("neuron_i"), F.col("j").alias("neuron_j"), *[F.col("w")[k].alias(f"dim_{f}") for k, f in enumerate(config.features)])
    publish("codebook", weights)
    publish("checkpoints", spark.createDataFrame([(c["iteration"], float(c["progress"]), float(c["mqe"]), float(c["radius"])) for c in checkpoints], "iteration int, progress double, mqe double, radius double"))
    assigned = som.assign(normalized, cb, [config.id_col])
    for name, frame in analyse(assigned, normalized, df.select(config.id_col, *config.features), cb, config).items():
        publish(name, frame)
    manifest = {"run_id": run_id, "folder": folder, "config": json.dumps(asdict(config), sort_keys=True), "figures": json.dumps(figures, sort_keys=True)}
    commit = spark.createDataFrame([tuple(manifest.values())], "run_id string, folder string, config string, figures string")
    commit.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifests")
    return manifest


def manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest manifest of each run, or None where nothing has been published."""
    found = try_read(spark, f"{root.rstrip('/')}/manifests")
    if found is None:
        return None
    names = [c for c in found.columns if c != "run_id"]
    return found.groupBy("run_id").agg(F.max_by(F.struct(*names), F.struct("published_at", "folder")).alias("m")).select("run_id", "m.*")


def published(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    """A table of a published run; a run without a manifest does not exist."""
    known = manifests(spark, root)
    row = None if known is None else known.where(F.col("run_id") == run_id).first()
    if row is None:
        raise LookupError(f"no published run {run_id!r}")
    return spark.read.parquet(f"{row['folder']}/{name}")


def run_figures(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, table, rows, figures) of all published runs: what was observed while they were written."""
    known = manifests(spark, root)
    if known is None:
        return spark.createDataFrame([], "run_id string, table string, rows long, figures map<string,double>")
    parsed = known.select("run_id", F.explode(F.from_json("figures", "map<string,map<string,double>>")).alias("table", "seen"))
    return parsed.select("run_id", "table", F.col("seen")["rows"].cast("long").alias("rows"), F.map_filter("seen", lambda k, _: k != "rows").alias("figures"))
