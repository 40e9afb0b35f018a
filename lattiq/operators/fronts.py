"""Front numbers of many points: one more than the largest front of a point that dominates it.

With two objectives a point is two places: its position by (first, second) and by (second,
first). One of two distinct points dominates the other exactly if it comes first in both. Both
orders are cut into strips of equal size, which gives a grid of cells. A cell needs three things of
the cells before it: the steps of the largest front by the second place in its row, the same by
the first place in its column, and one number for all cells before both. So all cells of a
diagonal are ranked at once, each in a task of its own with at most a strip of points and of steps.

With more objectives, strips of the lexicographic order are ranked one after another; a ranked
strip meets every later strip in a task of its own.
"""

from __future__ import annotations

import bisect
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lattiq.operators.sequences import positions
from lattiq.session import materialize, scratch_root

CELL = "i long, j long, kind string, x long, y long, front int"


def rank_points(points: DataFrame, objs: list[str], strip: int = 20_000) -> DataFrame:
    """*points* (distinct) with `front`, an int. No task holds more than two strips of *strip* points.

    A point with a missing (null or NaN) objective dominates none and none dominates it: front 0.
    """
    if len(objs) < 2:
        points, objs = points.withColumn("_zero", F.lit(0.0)), [*objs, "_zero"]
        return rank_points(points, objs, strip).drop("_zero")
    whole = F.lit(True)
    for o in objs:
        whole = whole & F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double"))
    apart = points.where(~whole).withColumn("front", F.lit(0))
    ranked = _by_grid(points.where(whole), objs, strip) if len(objs) == 2 else _by_strips(points.where(whole), objs, strip)
    return ranked.unionByName(apart)


def _by_grid(points: DataFrame, objs: list[str], strip: int) -> DataFrame:
    spark, root = points.sparkSession, f"{scratch_root(points.sparkSession)}/fronts-{uuid.uuid4().hex}"
    placed = positions(points, objs).withColumnRenamed("position", "_x").drop("rows")
    placed = positions(placed, objs[::-1]).withColumnRenamed("position", "_y")
    cells = placed.withColumns({"_i": F.floor(F.col("_x") / strip), "_j": F.floor(F.col("_y") / strip), "_w": F.floor(F.col("_x") / strip) + F.floor(F.col("_y") / strip)})
    cells.repartition("_w", "_i").write.partitionBy("_w").parquet(f"{root}/cells")
    cells = spark.read.schema(cells.schema).parquet(f"{root}/cells")
    n = cells.count()
    side, made = -(-n // strip), {}
    for w in range(2 * side - 1):
        given = cells.where(F.col("_w") == w).select(F.col("_i").alias("i"), F.col("_j").alias("j"), F.lit("point").alias("kind"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.lit(None).cast("int").alias("front"))
        for before in (w - 1, w - 2):
            if before in made:
                given = given.unionByName(made[before].where((F.col("kind") != "point") & (F.col("i") + F.col("j") == w)))
        path = f"{root}/ranked/wave={w}"
        given.groupBy("i", "j").applyInPandas(_ranked_cell(side), CELL).write.parquet(path)
        made[w] = spark.read.schema(CELL).parquet(path)
    if not made:
        return points.withColumn("front", F.lit(0)).where(F.lit(False))
    ranked = spark.read.schema(CELL).parquet(f"{root}/ranked").where("kind = 'point'").select(F.col("x").alias("_x"), "front")
    return cells.join(ranked, "_x").select(*points.columns, "front")


def _ranked_cell(side: int):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        i, j = (int(k) for k in key)
        kinds = {k: g for k, g in f.groupby("kind")}
        none = f.iloc[:0]
        row, col = kinds.get("row", none).sort_values("y"), kinds.get("col", none).sort_values("x")
        corner = max(kinds.get("corner", none)["front"].astype(int), default=-1)
        mine = kinds.get("point", none).sort_values("x")
        xs, ys = mine["x"].to_numpy(np.int64), mine["y"].to_numpy(np.int64)
        step_x, step_f = col["x"].to_numpy(np.int64), np.append(col["front"].to_numpy(int), -1)  # [-1] where no step is before
        base = np.maximum(corner, step_f[np.searchsorted(step_x, xs) - 1]).tolist()
        at, top = row["y"].astype(int).tolist(), row["front"].astype(int).tolist()  # largest front up to a second place
        out = []
        for y, b in zip(ys.tolist(), base, strict=True):
            p = bisect.bisect_left(at, y)
            before = top[p - 1] if p else -1
            k = max(b, before) + 1
            out.append(k)
            q = bisect.bisect_right(top, k, p)
            at[p:q], top[p:q] = [y], [k]
        fronts = np.array(out, int)
        sx, sf = np.concatenate([step_x, xs]), np.concatenate([step_f[:-1], fronts])
        order = np.argsort(sx)
        sx, sf = sx[order], sf[order]
        rises = sf > np.concatenate([[-1], np.maximum.accumulate(sf)[:-1]]) if len(sf) else np.zeros(0, bool)
        corner = max([corner, *top[-1:], *sf[rises][-1:].tolist()])
        parts = [pd.DataFrame({"i": i, "j": j, "kind": "point", "x": xs, "y": ys, "front": fronts})]
        if i + 1 < side:
            parts.append(pd.DataFrame({"i": i + 1, "j": j, "kind": "row", "x": -1, "y": at, "front": top}))
        if j + 1 < side:
            parts.append(pd.DataFrame({"i": i, "j": j + 1, "kind": "col", "x": sx[rises], "y": -1, "front": sf[rises]}))
        if i + 1 < side and j + 1 < side and corner >= 0:
            parts.append(pd.DataFrame({"i": [i + 1], "j": [j + 1], "kind": ["corner"], "x": [-1], "y": [-1], "front": [corner]}))
        return pd.concat([p for p in parts if len(p)] or parts[:1])

    return run


def _by_strips(points: DataFrame, objs: list[str], strip: int) -> DataFrame:
    placed = positions(points, objs).drop("rows")
    left = materialize(placed.withColumns({"_s": F.floor(F.col("position") / strip), "_base": F.lit(0)}), "front-strips")
    done, strips = left.where(F.lit(False)).withColumnRenamed("_base", "front"), left.select("_s").distinct().count()
    for s in range(strips):
        ranked = left.where(F.col("_s") == s).groupBy("_s").applyInPandas(_ranked_strip(objs), done.schema)
        ranked = materialize(ranked, "front-strip")
        done = done.unionByName(ranked)
        if s + 1 < strips:
            met = ranked.withColumn("_to", F.explode(F.sequence(F.lit(s + 1).cast("long"), F.lit(strips - 1).cast("long"))))
            rest = left.where(F.col("_s") > s)
            left = materialize(rest.groupBy("_s").cogroup(met.groupBy("_to")).applyInPandas(_raised(objs), rest.schema), "front-strips")
    return done.select(*points.columns, "front")


def _ranked_strip(objs: list[str]):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("position")
        x, out = f[objs].to_numpy(float), f["_base"].to_numpy(np.int32).copy()
        for i in range(1, len(x)):
            out[i] = max(out[i], (out[:i] + 1)[(x[:i] <= x[i]).all(1)].max(initial=0))
        return f.assign(_base=out).rename(columns={"_base": "front"})

    return run


def _raised(objs: list[str]):
    def run(f: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        x, base = f[objs].to_numpy(float), f["_base"].to_numpy(np.int32).copy()
        by, front = met[objs].to_numpy(float), met["front"].to_numpy(np.int32) + 1
        for a in range(0, len(x), 256):
            below = np.ones((len(x[a : a + 256]), len(by)), bool)
            for k in range(len(objs)):
                below &= by[:, k] <= x[a : a + 256, k, None]
            base[a : a + 256] = np.maximum(base[a : a + 256], np.where(below, front, 0).max(1, initial=0))
        return f.assign(_base=base)

    return run
