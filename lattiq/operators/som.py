"""Self-organizing maps: codebooks, assignment, quality, batch and online training.

A codebook is small (neurons x dimensions) and lives on the driver as a numpy array; rows
never do. Assignment is an expression over columns for small maps and a numpy product in
Arrow batches for larger ones; a batch epoch is one aggregate over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lattiq.operators.grid import Grid, euclid
from lattiq.operators.pairwise import neighbour_losses, silhouette_rows

#: Bound on neurons x dimensions of a codebook that may be sent to all tasks.
MAX_CODEBOOK = 4_000_000
#: Up to this many terms, distances are written out as column expressions.
EXPRESSION_TERMS = 512


@dataclass(frozen=True)
class Codebook:
    grid: Grid
    features: tuple[str, ...]
    weights: np.ndarray = field(repr=False)  # (neurons, dims)

    def __post_init__(self) -> None:
        if self.weights.shape != (self.grid.size, len(self.features)):
            raise ValueError(f"weights have shape {self.weights.shape}")
        if self.weights.size > MAX_CODEBOOK:
            raise ValueError("the codebook is too large to be sent to all tasks")

    @classmethod
    def random(cls, grid: Grid, features: list[str], seed: int) -> Codebook:
        return cls(grid, tuple(features), np.random.RandomState(seed).rand(grid.size, len(features)))

    @classmethod
    def lattice(cls, grid: Grid, features: list[str]) -> Codebook:
        """Deterministic start: an arithmetic pattern of dyadic fractions."""
        k, d = np.meshgrid(np.arange(grid.size), np.arange(len(features)), indexing="ij")
        return cls(grid, tuple(features), ((k * 37 + d * 11) % 16) / 16.0 + 1 / 32)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *divmod(k, self.grid.n), w.tolist()) for k, w in enumerate(self.weights)]
        return spark.createDataFrame(rows, "nid int, i int, j int, w array<double>")

    def unit_norm(self) -> Codebook:
        norms = np.linalg.norm(self.weights, axis=1, keepdims=True)
        return Codebook(self.grid, self.features, self.weights / np.where(norms == 0, 1, norms))


def strip_masked(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns that are never there, and zero the masked cells of the others."""
    seen = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    gone = [c for c in cols if not seen[c]]
    return df.drop(*gone).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols if c not in gone})


def _gap2(features: tuple[str, ...], w: np.ndarray) -> Column:
    """Squared distance to one neuron; masked (null) cells count nothing."""
    out: Column | None = None
    for f, v in zip(features, w.tolist(), strict=True):
        e = F.coalesce(F.col(f) - F.lit(v), F.lit(0.0))
        out = e * e if out is None else out + e * e
    return out


def _nearest_expression(df: DataFrame, cb: Codebook, k: int) -> DataFrame:
    """The nearest neuron is the least of all; the second one the least of the others."""
    each = [F.struct(_gap2(cb.features, w).alias("d2"), F.lit(nid).alias("nid")) for nid, w in enumerate(cb.weights)]

    def least(structs: list[Column]) -> Column:
        return F.least(*structs) if len(structs) > 1 else structs[0]

    got = df.withColumn("_b", least(each))
    if k == 2:
        got = got.withColumn("_b2", least([F.when(F.col("_b.nid") != nid, s) for nid, s in enumerate(each)]))
    return got.withColumns({f"{c}{s}": F.col(f"_b{s}.{c}") for s in ("", "2")[:k] for c in ("nid", "d2")}).drop("_b", "_b2")


def nearest(df: DataFrame, cb: Codebook, k: int = 1) -> DataFrame:
    """*df* with nid and d2 of the nearest neuron (nid2, d22 of the second); ties take the lower nid."""
    if k not in (1, 2):
        raise ValueError("k is 1 or 2")
    if cb.weights.size <= EXPRESSION_TERMS:
        return _nearest_expression(df, cb, k)
    return _nearest_arrow(df, cb, k)


def _nearest_arrow(df: DataFrame, cb: Codebook, k: int, chunk: int = 1024) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(cb.weights)
    features = list(cb.features)
    names = [f"{c}{s}" for s in ("", "2")[:k] for c in ("nid", "d2")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{c} {'int' if c.startswith('nid') else 'double'}" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            x = np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], axis=1)
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            near, gaps = np.empty((len(x), k), np.int32), np.empty((len(x), k))
            for a in range(0, len(x), chunk):
                part, m = x[a : a + chunk], seen[a : a + chunk].astype(float)
                d = (part * part).sum(1)[:, None] - 2 * part @ w.T + m @ (w * w).T  # masked cells are zero in part and m
                at = np.argsort(d, axis=1, kind="stable")[:, :k]
                near[a : a + chunk] = at
                for t in range(k):
                    gaps[a : a + chunk, t] = (((part - w[at[:, t]]) * m) ** 2).sum(1)
            cols = [v for t in range(k) for v in (pa.array(near[:, t]), pa.array(gaps[:, t]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def assign(df: DataFrame, cb: Codebook, keep: list[str]) -> DataFrame:
    """Per row: bmu_i, bmu_j, bmu_key, qe, and qe_dims, the error of each feature (0 where masked)."""
    near = nearest(df.select(*keep, *[c for c in cb.features if c not in keep]), cb)
    weights = F.array(*[F.array(*[F.lit(v) for v in w]) for w in cb.weights.tolist()])
    own = F.element_at(weights, F.col("nid") + 1)
    dims = [x for d, f in enumerate(cb.features) for x in (F.lit(f), F.coalesce(F.abs(F.col(f) - own[d]), F.lit(0.0)))]
    i, j = F.floor(F.col("nid") / cb.grid.n).cast("int"), (F.col("nid") % cb.grid.n).cast("int")
    return near.select(*keep, "nid", i.alias("bmu_i"), j.alias("bmu_j"), F.concat_ws("_", i, j).alias("bmu_key"), F.sqrt("d2").alias("qe"), F.create_map(*dims).alias("qe_dims"))


def neuron_report(assigned: DataFrame, grid: Grid) -> DataFrame:
    """Every neuron with its hits, mean and largest error; empty neurons have zeros."""
    g = assigned.groupBy("nid").agg(F.count(F.lit(1)).alias("hits"), F.avg("qe").alias("m"), F.max("qe").alias("x"))
    zero = F.lit(0)
    out = grid.neurons(assigned.sparkSession).select("nid", "neuron_key").join(g, "nid", "left")
    return out.select("neuron_key", F.coalesce("hits", zero).alias("hits"), F.round(F.coalesce("m", zero), 6).alias("qe_mean"), F.round(F.coalesce("x", zero), 6).alias("qe_max"))


def dead_neurons(assigned: DataFrame, grid: Grid) -> DataFrame:
    """Number and share of neurons without rows; no rows at all leave every neuron dead."""
    return assigned.agg((grid.size - F.count_distinct("nid")).alias("dead")).select("dead", F.round(F.col("dead") / grid.size, 6).alias("dead_ratio"))


def map_quality(df: DataFrame, cb: Codebook) -> DataFrame:
    """MQE and topographic error (best and second neuron are no neighbours), from one pass."""
    near = nearest(df.select(*cb.features), cb, 2)
    n = cb.grid.n

    def at(c: str) -> tuple[Column, Column]:
        return F.floor(F.col(c) / n), F.col(c) % n

    apart = cb.grid.steps(*at("nid"), *at("nid2")) > 1
    return near.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sqrt("d2")), 6).alias("mqe"), F.round(F.avg(apart.cast("double")), 6).alias("topographic_error"))


def topological_correlation(cb: Codebook, spark: SparkSession) -> DataFrame:
    """Spearman correlation of weight and grid distances over pairs of neurons; 0 when either is constant."""
    from lattiq.operators.windows import spearman

    f = cb.frame(spark)
    x, y = cb.grid.xy(F.col("i"), F.col("j"))
    f = f.withColumns({"x": x, "y": y})
    a, b = f.alias("a"), f.alias("b")
    pairs = a.join(b, F.col("a.nid") < F.col("b.nid")).select(
        F.lit(1).alias("k"), F.round(euclid(F.col("a.w"), F.col("b.w")), 9).alias("dw"), F.round(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")), 9).alias("dg")
    )
    return spearman(pairs, "dw", "dg", ["k"]).select(F.round(F.coalesce("rho", F.lit(0.0)), 6).alias("topological_correlation"), F.col("n").alias("pairs"))


def neighbourhood(grid: Grid, radius: float) -> np.ndarray:
    """Gaussian influence between all pairs of neurons."""
    k = np.arange(grid.size)
    i, j = np.divmod(k, grid.n)
    if grid.hex:
        q = j - i // 2
        cube = np.stack([q, -q - i, i], axis=1)
        d = np.abs(cube[:, None] - cube[None]).sum(2) / 2
    else:
        d = np.hypot(i[:, None] - i[None], j[:, None] - j[None])
    return np.exp(-(d**2) / (2 * radius**2 + 1e-8))


def neuron_sums(df: DataFrame, cb: Codebook) -> DataFrame:
    """Per neuron and feature: sum and count of the unmasked values of its rows."""
    near = nearest(df.select(*cb.features), cb)
    return near.groupBy("nid").agg(*[f(c).alias(f"{k}_{c}") for c in cb.features for k, f in (("s", F.sum), ("c", F.count))], F.avg(F.sqrt("d2")).alias("qe"), F.count(F.lit(1)).alias("hits"))


def batch_epoch(df: DataFrame, cb: Codebook, radius: float) -> tuple[Codebook, float]:
    """One epoch of the batch rule, and the MQE before it. One aggregate; its neurons come to the driver."""
    rows = neuron_sums(df, cb).collect()
    sums, counts = np.zeros_like(cb.weights), np.zeros_like(cb.weights)
    error, n = 0.0, 0
    for r in rows:
        for d, c in enumerate(cb.features):
            sums[r["nid"], d], counts[r["nid"], d] = r[f"s_{c}"] or 0.0, r[f"c_{c}"]
        error += r["qe"] * r["hits"]
        n += r["hits"]
    h = neighbourhood(cb.grid, radius)
    mass = h @ counts
    moved = np.where(mass > 1e-12, (h @ sums) / np.where(mass > 1e-12, mass, 1), cb.weights)
    return Codebook(cb.grid, cb.features, moved), error / n if n else 0.0


@dataclass(frozen=True)
class TrainSpec:
    epochs: int = 8
    start_radius_ratio: float = 0.5
    end_radius: float = 0.5
    seed: int = 42
    #: Called with the checkpoints so far; true ends the training.
    early_stop: Callable[[list[dict]], bool] | None = None
    #: Called with the last checkpoint; a factor on the radius, clipped to 0.5 .. 2.
    radius_factor: Callable[[dict], float] | None = None


def train(df: DataFrame, grid: Grid, features: list[str], spec: TrainSpec = TrainSpec(), start: Codebook | None = None) -> tuple[Codebook, list[dict]]:
    """Batch training: a driver loop of epochs, each one Spark job over *df*, with checkpoints."""
    cb, checkpoints, factor = start or Codebook.random(grid, features, spec.seed), [], 1.0
    first = max(grid.m, grid.n) * spec.start_radius_ratio
    for t in range(spec.epochs):
        share = t / max(1, spec.epochs - 1)
        radius = max(1e-3, factor * (first + share * (spec.end_radius - first)))
        cb, mqe = batch_epoch(df, cb, radius)
        checkpoints.append({"iteration": t, "progress": (t + 1) / spec.epochs, "mqe": mqe, "radius": radius, "radius_factor": factor})
        if spec.early_stop and len(checkpoints) >= 2 and spec.early_stop(checkpoints):
            break
        if spec.radius_factor:
            factor = float(np.clip(factor * np.clip(spec.radius_factor(checkpoints[-1]), 0.5, 2.0), 0.05, 5.0))
    return cb, checkpoints


def sample_order(n: int, num_batches: int, percent: float, iterations: int, rng: np.random.Generator, reshuffle: bool) -> Iterator[np.ndarray]:
    """Rows of each iteration: a share of every section, walked through and reshuffled at its end, or drawn at random."""
    sections = np.array_split(rng.permutation(n), max(1, num_batches))
    at = [0] * len(sections)
    for _ in range(iterations):
        out = []
        for k, s in enumerate(sections):
            need = min(len(s), int(np.ceil(len(s) * percent / 100)))
            if not reshuffle:
                out.append(rng.choice(s, need, replace=False))
                continue
            if at[k] + need > len(s):
                head = s[at[k] :]
                sections[k] = s = rng.permutation(s)
                out += [head, s[: need - len(head)]]
                at[k] = need - len(head)
            else:
                out.append(s[at[k] : at[k] + need])
                at[k] += need
        yield np.concatenate(out) if out else np.empty(0, np.int64)


def train_online(x: np.ndarray, grid: Grid, config: dict) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Sequential training of one configuration in one task: weights, visits of each row, checkpoints."""
    rng = np.random.default_rng(int(config["seed"]))
    w = np.random.RandomState(int(config["seed"])).rand(grid.size, x.shape[1])
    seen = ~np.isnan(x)
    x = np.where(seen, x, 0.0)
    w[:, ~seen.any(0)] = 0.0
    steps, percent = max(1, int(config.get("iterations", 50))), float(config.get("percent", 10.0))
    visits, history = np.zeros(len(x), np.int64), []
    first = max(grid.m, grid.n) * float(config.get("radius_ratio", 0.5))
    for t, rows in enumerate(sample_order(len(x), int(config.get("num_batches", 1)), percent, steps, rng, bool(config.get("reshuffle", True)))):
        share = t / max(1, steps - 1)
        rate = float(config.get("start_rate", 0.5)) * (1 - share) + float(config.get("end_rate", 0.02)) * share
        h = neighbourhood(grid, max(0.3, first * (1 - share)))
        for r in rows:
            d = ((w - x[r]) * seen[r]) ** 2
            w += rate * h[int(d.sum(1).argmin())][:, None] * (x[r] - w) * seen[r]
            visits[r] += 1
        if t % max(1, steps // 10) == 0 or t == steps - 1:
            blocks = (((x[s : s + 1024, None] - w[None]) * seen[s : s + 1024, None]) ** 2 for s in range(0, len(x), 1024))
            nearest_gap = np.concatenate([np.sqrt(g.sum(2).min(1)) for g in blocks])
            history.append({"iteration": t, "mqe": float(nearest_gap.mean()), "rate": rate})
    return w, visits, history


def train_many(data: np.ndarray, grid: Grid, configs: DataFrame) -> DataFrame:
    """Train one online map a configuration (uid, seed, ...) as Spark tasks over a bounded training matrix."""
    if data.nbytes > 200_000_000:
        raise ValueError("online training takes a bounded matrix; train large tables by batch epochs")
    shared = configs.sparkSession.sparkContext.broadcast(data)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        config = pdf.iloc[0].to_dict()
        w, visits, history = train_online(shared.value, grid, config)
        return pd.DataFrame([{"uid": str(config["uid"]), "seed": int(config["seed"]), "mqe": history[-1]["mqe"], "first_mqe": history[0]["mqe"], "never_visited": float((visits == 0).mean()), "weights": w.ravel().tolist()}])

    return configs.groupBy("uid").applyInPandas(run, "uid string, seed long, mqe double, first_mqe double, never_visited double, weights array<double>")


def distance_sample(df: DataFrame, id_col: str, cap: int = 2000) -> DataFrame:
    """At most *cap* rows, those with the least hashes of the id: the quadratic measures are defined on samples."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(cap)


def trust_continuity(points: DataFrame, id_col: str, vector: str, i: str, j: str, k: int = 5) -> DataFrame:
    """Trustworthiness and continuity at *k* of a sample: neighbours gained and lost by the map."""
    rows = neighbour_losses(points, id_col, vector, i, j, k)
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("gained"), F.lit(0)).alias("t"), F.coalesce(F.sum("lost"), F.lit(0)).alias("c"))
    norm = 2.0 / (F.col("n") * k * (2 * F.col("n") - 3 * k - 1))
    return one.select("n", F.lit(k).alias("k"), F.round(1 - norm * F.col("t"), 6).alias("trustworthiness"), F.round(1 - norm * F.col("c"), 6).alias("continuity"))


def silhouette(points: DataFrame, id_col: str, vector: str, cluster: str) -> DataFrame:
    """Exact Euclidean silhouette of a sample by cluster; single rows score 0."""
    rows = silhouette_rows(points, id_col, vector, cluster)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("silhouette"))
