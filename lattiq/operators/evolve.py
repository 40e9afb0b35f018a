"""Evolutionary search: gene operators on the driver, evaluation as scans of the table, ranking as DataFrames.

A population is at most a few hundred configurations. Evaluating them is the work: all of them
train side by side, one scan an iteration; genes are drawn and crossed by a seeded generator.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lattiq.functions.scalar import log_interpolate  # noqa: F401  (the same rule for tables)
from lattiq.operators import pareto
from lattiq.operators.grid import Grid
from lattiq.operators.many import Config, roughness, train_together


def uid_of(genes: dict) -> str:
    return hashlib.md5(json.dumps({k: v for k, v in genes.items() if k != "uid"}, sort_keys=True).encode()).hexdigest()


def map_bounds(rows: int) -> tuple[int, int]:
    """Sides of a map for *rows*: 0.7 to 1.3 times the root of 5 sqrt(rows), 8 at least."""
    side = np.sqrt(5 * np.sqrt(rows))
    low = max(8, int(round(0.7 * side)))
    return low, max(low + 2, int(round(1.3 * side)))


def _round(value: float, spec: dict) -> float | int:
    if spec["type"] == "int":
        return int(np.clip(round(value), spec["min"], spec["max"]))
    return float(np.clip(round(value, 4 if spec.get("log_scale") else 2), spec["min"], spec["max"]))


def _scale(spec: dict):
    return (np.log, np.exp) if spec.get("log_scale") else (float, float)


def random_genes(space: dict, rng: np.random.Generator) -> dict:
    out = {}
    for name, spec in space.items():
        if not isinstance(spec, dict):
            out[name] = spec
        elif spec["type"] == "categorical":
            out[name] = spec["values"][int(rng.integers(len(spec["values"])))]
        elif spec["type"] == "discrete_int_pair":
            out[name] = [int(x) for x in rng.integers(spec["min"], spec["max"] + 1, 2)]
        else:
            to, back = _scale(spec)
            out[name] = _round(back(rng.uniform(to(spec["min"]), to(spec["max"]))), spec)
    return out


def sbx(a: float, b: float, spec: dict, rng: np.random.Generator, eta: float = 20.0) -> tuple[float, float]:
    """Simulated binary crossover in the gene's own scale; half of the genes and equal parents are left alone."""
    to, back = _scale(spec)
    x, y = to(a), to(b)
    if rng.random() >= 0.5 or abs(x - y) < 1e-12:
        return a, b
    u = rng.random()
    beta = (2 * u) ** (1 / (eta + 1)) if u <= 0.5 else (1 / (2 * (1 - u))) ** (1 / (eta + 1))
    return tuple(_round(back(v), spec) for v in (0.5 * ((1 + beta) * x + (1 - beta) * y), 0.5 * ((1 - beta) * x + (1 + beta) * y)))


def polynomial(value: float, spec: dict, rng: np.random.Generator, eta: float = 20.0) -> float:
    """Polynomial mutation whose spread depends on the distance to the bound that lies in its way."""
    to, back = _scale(spec)
    low, high = to(spec["min"]), to(spec["max"])
    if high <= low:
        return value
    x, u = to(value), rng.random()
    if u < 0.5:
        room = 1 - (x - low) / (high - low)
        delta = (2 * u + (1 - 2 * u) * room ** (eta + 1)) ** (1 / (eta + 1)) - 1
    else:
        room = 1 - (high - x) / (high - low)
        delta = 1 - (2 * (1 - u) + 2 * (u - 0.5) * room ** (eta + 1)) ** (1 / (eta + 1))
    return _round(back(np.clip(x + delta * (high - low), low, high)), spec)


def crossover(a: dict, b: dict, space: dict, rng: np.random.Generator) -> tuple[dict, dict]:
    x, y = dict(a), dict(b)
    for name, spec in space.items():
        if isinstance(spec, dict) and spec["type"] in ("float", "int"):
            x[name], y[name] = sbx(a[name], b[name], spec, rng)
        elif isinstance(spec, dict) and rng.random() < 0.5:
            x[name], y[name] = b[name], a[name]
    return x, y


def mutate(genes: dict, space: dict, rng: np.random.Generator, rate: float = 0.1) -> dict:
    out = dict(genes)
    for name, spec in space.items():
        if isinstance(spec, dict) and rng.random() < rate:
            out[name] = polynomial(genes[name], spec, rng) if spec["type"] in ("float", "int") else random_genes({name: spec}, rng)[name]
    return out


def tournament(population: list[dict], rng: np.random.Generator, k: int = 3) -> dict:
    """The best of *k* drawn: lowest front, then largest crowding."""
    drawn = rng.choice(len(population), min(k, len(population)), replace=False)
    return min((population[i] for i in drawn), key=lambda p: (p["front"], -p["crowding"], p["uid"]))


def evaluate(df: DataFrame, id_col: str, features: list[str], population: list[dict]) -> list[dict]:
    """Train and score a whole population side by side: each iteration is one scan of the table for all of them."""
    configs = []
    for g in population:
        own = {k: g[k] for k in ("seed", "iterations", "num_batches", "start_rate", "end_rate", "radius_ratio") if k in g}
        configs.append(Config(uid_of(g), Grid(*g.get("map_size", [8, 8]), g.get("map_type", "hex")), percent=int(g.get("percent", 10)), reshuffle=bool(g.get("reshuffle", True)), **own))
    books, scores = train_together(df, id_col, features, configs)
    by = {c.uid: (c, g, b) for c, g, b in zip(configs, population, books, strict=True)}
    out = []
    for s in scores:
        c, g, b = by[s["uid"]]
        out.append({"uid": c.uid, "genes": json.dumps(g, sort_keys=True), "map_m": c.grid.m, "map_n": c.grid.n, "mqe": s["mqe"], "first_mqe": s["first_mqe"], "te": s["te"], "dead": s["dead"], "u_max": roughness(b), "d_max": s["d_max"]})
    return out


SCORES = "uid string, genes string, map_m int, map_n int, mqe double, first_mqe double, te double, dead double, u_max double, d_max double"


def calibrate(df: DataFrame, id_col: str, features: list[str], space: dict, probes: int = 15, share: float = 0.3, seed: int = 0) -> tuple[float, DataFrame]:
    """(limit of disorder, scored probes): random configurations are trained side by side for a share of their iterations.

    The limit is the 70th percentile of the larger of the U-matrix maximum and the largest mean error of a neuron, over
    the probes that have any disorder; 1.0 without such probes.
    """
    rng = np.random.default_rng(seed)
    genes = [random_genes(space, rng) for _ in range(probes)]
    drawn = list({uid_of(g): g | {"iterations": max(1, round(share * g.get("iterations", 15)))} for g in genes}.values())
    scores = evaluate(df, id_col, features, drawn) if drawn else []
    table = df.sparkSession.createDataFrame(scores, SCORES).withColumn("org_max", F.greatest("u_max", "d_max"))
    return float(pareto.calibrated_limit(table.where("org_max > 0"), "org_max").first()["limit"]), table


def ranked(scored: DataFrame, n_rows: int, limit: float = 1.0) -> DataFrame:
    most = pareto.dead_threshold(F.col("map_m"), F.col("map_n"), F.lit(float(n_rows)))
    x = scored.withColumns({"ratio": F.round(F.col("mqe") / F.greatest("first_mqe", F.lit(1e-10)), 9), "cv": F.round(pareto.constraint_violation(F.col("u_max"), F.col("d_max"), F.col("dead"), most, limit), 9)})
    return pareto.crowding(pareto.fronts(x, "uid", ["ratio", "te"], "cv"), "uid", "front", ["ratio", "te"])


def search(df: DataFrame, id_col: str, features: list[str], space: dict, population: int = 8, generations: int = 2, seed: int = 0, probes: int = 0) -> DataFrame:
    """Generation loop: evaluate new genes, rank them with the survivors, breed. Returns the last ranked generation.

    With *probes* the limit of disorder is calibrated first. The table is only scanned; what comes to the driver is a population.
    """
    spark, rng = df.sparkSession, np.random.default_rng(seed)
    n_rows = df.count()
    limit = calibrate(df, id_col, features, space, probes, seed=seed + 1)[0] if probes else 1.0
    genes = [random_genes(space, rng) for _ in range(population)]
    kept: list[dict] = []
    for generation in range(generations):
        known = {k["uid"] for k in kept}
        new = [g for g in {uid_of(g): g for g in genes}.values() if uid_of(g) not in known]
        scores = evaluate(df, id_col, features, new) if new else []
        base = [{c: k[c] for c in ("uid", "genes", "map_m", "map_n", "mqe", "first_mqe", "te", "dead", "u_max", "d_max")} for k in kept]
        table = spark.createDataFrame(base + scores, SCORES)
        kept = [r.asDict() for r in pareto.survivors(ranked(table, n_rows, limit), "uid", population).collect()]  # a population
        genes, tries = [], 0
        while len(genes) < population and tries < 3 * population:
            tries += 1
            a, b = (json.loads(tournament(kept, rng)["genes"]) for _ in range(2))
            genes += [mutate(c, space, rng) for c in crossover(a, b, space, rng)]
    out = [(generation, k["uid"], k["genes"], k["ratio"], k["te"], k["dead"], k["cv"], k["front"]) for k in kept]
    return spark.createDataFrame(out, "generation int, uid string, genes string, ratio double, te double, dead double, cv double, front int")
