"""Multi-objective ranking: constrained dominance, fronts, crowding, constraints, metrics."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq.operators.fronts import rank_points
from lattiq.operators.sequences import positions
from lattiq.session import materialize

FEASIBLE = 1e-9


def repair_config(df: DataFrame) -> DataFrame:
    """Swap reversed bounds, clamp multipliers, and settle growth_g; absent columns are left alone."""
    out = {}
    for hi, lo in (("lr_start", "lr_end"), ("radius_start", "radius_end"), ("batch_end", "batch_start")):
        if hi in df.columns and lo in df.columns:
            out |= {hi: F.greatest(hi, lo), lo: F.least(hi, lo)}
    if "epoch_multiplier" in df.columns:
        out["epoch_multiplier"] = F.greatest(F.lit(0.1), F.col("epoch_multiplier"))
    if "growth_g" in df.columns:
        linear = F.coalesce(F.col("all_linear"), F.lit(False)) if "all_linear" in df.columns else F.lit(False)
        out["growth_g"] = F.when(linear, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), F.col("growth_g")))
    if "num_batches" in df.columns:
        out["num_batches"] = F.greatest(F.lit(1), F.col("num_batches"))
    return df.withColumns(out)


def dead_threshold(m: Column, n: Column, samples: Column) -> Column:
    """Share of dead neurons that a map of this size may have."""
    return F.greatest(F.lit(0.3), F.least(F.lit(0.85), 1.0 - samples / F.greatest(F.lit(1), m * n) / 10.0))


def constraint_violation(u_max: Column, d_max: Column, dead: Column, threshold: Column, limit: float = 1.0) -> Column:
    """Disorder above *limit* plus a graded penalty on dead neurons above *threshold*."""
    zero = F.lit(0.0)
    disorder = F.greatest(zero, F.greatest(F.coalesce(u_max, zero), F.coalesce(d_max, zero)) - limit)
    excess = F.round(F.greatest(zero, F.coalesce(dead, zero) - threshold), 9)
    grade = F.when(excess == 0, 0.0).when(excess < 0.2, 1.5).when(excess < 0.4, 2.5).otherwise(5.0)
    return disorder + excess * grade


def objectives(mqe: Column, first_mqe: Column, ratio: Column, te: Column, rho: Column) -> list[Column]:
    """Error ratio (computed where it is missing), topographic error, and one minus the correlation."""
    return [F.coalesce(ratio, F.when(first_mqe > 0, mqe / first_mqe), F.lit(1.0)), F.coalesce(te, F.lit(1.0)), 1 - F.coalesce(rho, F.lit(0.0))]


def dominates(p: str, q: str, objs: list[str], cv: str, skip_null: bool = False) -> Column:
    """Does row alias *p* dominate *q*: feasible first, then smaller violation, then Pareto."""
    pc, qc = F.col(f"{p}.{cv}"), F.col(f"{q}.{cv}")
    pf, qf = pc < FEASIBLE, qc < FEASIBLE
    le, lt = [], []
    for o in objs:
        a, b = F.col(f"{p}.{o}"), F.col(f"{q}.{o}")
        le.append(F.coalesce(a <= b, F.lit(True)) if skip_null else a <= b)
        lt.append(F.coalesce(a < b, F.lit(False)))
    all_le, any_lt = le[0], lt[0]
    for x, y in zip(le[1:], lt[1:], strict=True):
        all_le, any_lt = all_le & x, any_lt | y
    return F.when(pf & qf, all_le & any_lt).when(pf, F.lit(True)).when(qf, F.lit(False)).otherwise(pc < qc)


def first_front(df: DataFrame, uid: str, objs: list[str], cv: str, skip_null: bool = False) -> DataFrame:
    """Rows that no other row dominates. Distinct objective vectors meet, not rows.

    Unless missing objectives are skipped, dominance is transitive: each partition first
    drops what its own points dominate, and only what is left meets.
    """
    points = df.select(*objs, cv).distinct()
    if not skip_null:
        points = materialize(points.mapInPandas(_own_front(objs, cv), points.schema), "own-fronts")
    points = points.withColumn("_id", F.xxhash64(*objs, cv))
    keep = points.join(_beaten(points, objs, cv, skip_null), "_id", "left_anti")
    same = [df[c].eqNullSafe(keep[c]) for c in (*objs, cv)]
    return df.join(keep, functools.reduce(operator.and_, same), "left_semi")


def _beaten(points: DataFrame, objs: list[str], cv: str, skip_null: bool) -> DataFrame:
    p, q = points.alias("p"), points.alias("q")
    return q.join(p, dominates("p", "q", objs, cv, skip_null), "left_semi").select("_id")


def _dominated(x: np.ndarray, xc: np.ndarray, by: np.ndarray, byc: np.ndarray) -> np.ndarray:
    """Which rows of *x* (violations *xc*) some row of *by* dominates."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(x), 256):
        q, qc, p, pc = x[a : a + 256, None], xc[a : a + 256, None], by[None], byc[None]
        pareto = (p <= q).all(2) & (p < q).any(2)
        pf, qf = pc < FEASIBLE, qc < FEASIBLE
        out[a : a + 256] = np.where(pf & qf, pareto, np.where(pf, True, np.where(qf, False, pc < qc))).any(1)
    return out


def _own_front(objs: list[str], cv: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            for a in range(0, len(f), 1000):
                held = f[a : a + 1000] if held is None else pd.concat([held, f[a : a + 1000]])
                x, c = held[objs].to_numpy(float), held[cv].to_numpy(float)
                held = held[~_dominated(x, c, x, c)]
        if held is not None:
            yield held

    return run


def fronts(df: DataFrame, uid: str, objs: list[str], cv: str, strip: int = 20_000) -> DataFrame:
    """Front number of each row, for all fronts.

    Distinct feasible points are ranked in strips of *strip* points (`operators/fronts.py`).
    Infeasible rows follow, a front for each violation; a missing violation is of the first of them.
    """
    good = materialize(df.where(F.col(cv) < FEASIBLE).select(*objs).distinct(), "front-points")
    feasible = materialize(rank_points(good, objs, strip), "fronts")
    after = (feasible.agg(F.max("front")).first()[0] or 0) + 1 if not good.isEmpty() else 0
    bad = df.where(~F.coalesce(F.col(cv) < FEASIBLE, F.lit(False)))
    levels = positions(bad.select(F.col(cv).alias("_cv")).where("_cv IS NOT NULL").distinct(), ["_cv"]).select("_cv", (F.col("position") + after).cast("int").alias("front"))
    behind = bad.join(levels, F.col(cv) == F.col("_cv"), "left").drop("_cv").withColumn("front", F.coalesce("front", F.lit(after)))
    named = feasible.select(*[F.col(o).alias(f"_f{k}") for k, o in enumerate(objs)], "front")
    same = functools.reduce(operator.and_, [F.col(o).eqNullSafe(F.col(f"_f{k}")) for k, o in enumerate(objs)])
    ahead = df.where(F.col(cv) < FEASIBLE).join(named, same).drop(*[f"_f{k}" for k in range(len(objs))])
    return ahead.unionByName(behind)


def crowding(df: DataFrame, uid: str, front: str, objs: list[str]) -> DataFrame:
    """Crowding distance within fronts: ends are infinite, flat objectives count nothing."""
    whole = Window.partitionBy(front)
    total = F.lit(0.0)
    for k, o in enumerate(objs):
        w = whole.orderBy(o, uid)
        span = F.max(o).over(whole) - F.min(o).over(whole)
        before, after = F.lag(o).over(w), F.lead(o).over(w)
        part = F.when(span < 1e-8, 0.0).when(before.isNull() | after.isNull(), float("inf")).otherwise((after - before) / span)
        df = df.withColumn(f"_c{k}", part)
        total = total + F.col(f"_c{k}")
    return df.withColumn("crowding", total).drop(*[f"_c{k}" for k in range(len(objs))])


def survivors(df: DataFrame, uid: str, size: int) -> DataFrame:
    """The first *size* rows by front, then descending crowding."""
    return df.orderBy("front", F.desc("crowding"), uid).limit(size)


def dominated_members(df: DataFrame, uid: str, objs: list[str], cv: str) -> DataFrame:
    """Members of an archive that another member dominates; missing objectives are skipped."""
    return df.join(first_front(df, uid, objs, cv, skip_null=True).select(uid), uid, "left_anti")


def front_metrics(front: DataFrame, uid: str, objs: list[str]) -> DataFrame:
    """Size, spreads, and spacing (deviation of the distance to the nearest other point)."""
    a, b = front.alias("a"), front.alias("b")
    gap = sum((F.abs(F.col(f"a.{o}") - F.col(f"b.{o}")) for o in objs), F.lit(0.0))
    near = a.join(b, F.col(f"a.{uid}") != F.col(f"b.{uid}")).groupBy(F.col(f"a.{uid}").alias(uid)).agg(F.min(gap).alias("d"))
    spread = front.agg(F.count(F.lit(1)).alias("front_size"), *[F.round(F.max(o) - F.min(o), 6).alias(f"spread_{o}") for o in objs])
    return spread.join(F.broadcast(near.agg(F.round(F.coalesce(F.stddev_pop("d"), F.lit(0.0)), 6).alias("spacing"))))  # one row each


def hypervolume(points: np.ndarray, reference: np.ndarray) -> float:
    """Exact dominated volume of a small front, by slicing along the last objective."""
    inside = points[(points < reference).all(axis=1)]
    if not len(inside):
        return 0.0
    if points.shape[1] == 1:
        return float(reference[0] - inside[:, 0].min())
    inside = inside[np.argsort(inside[:, -1], kind="stable")]
    heights = np.append(inside[:, -1], reference[-1])
    return sum(float(b - a) * hypervolume(inside[: k + 1, :-1], reference[:-1]) for k, (a, b) in enumerate(itertools.pairwise(heights)) if b > a)


def hypervolume_2d(front: DataFrame, objs: list[str], reference: tuple[float, float]) -> DataFrame:
    """Area that a front of two objectives dominates below *reference*: slabs between neighbours, of any number."""
    x, y = objs
    inside = front.where((F.col(x) < reference[0]) & (F.col(y) < reference[1])).groupBy(x).agg(F.min(y).alias(y))
    p = positions(inside, [x])
    above = p.select((F.col("position") + 1).alias("position"), F.col(y).alias("_above"))
    slab = (reference[0] - F.col(x)) * (F.coalesce("_above", F.lit(reference[1])) - F.col(y))
    return p.join(above, "position", "left").agg(F.round(F.coalesce(F.sum(slab), F.lit(0.0)), 6).alias("hypervolume"))


def archive_evolution(df: DataFrame, generation: str, objs: list[str], cv: str) -> DataFrame:
    """Per generation: members, feasible ones, and the least of each objective and of the violation."""
    least = [F.min(c).alias(f"least_{c}") for c in (*objs, cv)]
    return df.groupBy(generation).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col(cv) < FEASIBLE).alias("feasible"), *least)


def next_dominators(df: DataFrame, uid: str, generation: str, objs: list[str], cv: str) -> DataFrame:
    """Per member: how many of the next generation dominate it."""
    later = df.withColumn(generation, F.col(generation) - 1).alias("p")
    met = df.alias("q").join(later, (F.col(f"p.{generation}") == F.col(f"q.{generation}")) & dominates("p", "q", objs, cv), "left")
    return met.groupBy(F.col(f"q.{uid}").alias(uid), F.col(f"q.{generation}").alias(generation)).agg(F.count(F.col(f"p.{uid}")).alias("dominators"))


def calibrated_limit(probes: DataFrame, value: str, share: float = 0.7, otherwise: float = 1.0) -> DataFrame:
    """The percentile of the probes' maxima that serves as limit; without probes a fixed one."""
    return probes.agg(F.round(F.coalesce(F.percentile(value, share), F.lit(otherwise)), 6).alias("limit"), F.count(value).alias("probes"))


def recommendations(df: DataFrame, cols: list[str], penalized: str, share: float = 0.95) -> DataFrame:
    """Parameter values nearly always penalised, and those penalised more than half the time."""
    long = df.select(F.col(penalized).cast("double").alias("_p"), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["_p"], cols, "parameter", "value")
    g = long.groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_p"), 6).alias("penalty_rate"))
    return g.withColumn("advice", F.when(F.col("penalty_rate") >= share, "remove").when(F.col("penalty_rate") > 0.5, "restrict")).where("advice IS NOT NULL")
