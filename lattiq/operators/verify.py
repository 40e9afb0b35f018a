"""Verification against ground truth."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq.operators.sequences import positions
from lattiq.operators.stats import dominant
from lattiq.session import materialize, shuffle_partitions


def linear_r2(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """R2 of y on two predictors, from the normal equations."""
    a = df.agg(*[F.covar_pop(p, q).alias(n) for n, p, q in (("s11", x1, x1), ("s22", x2, x2), ("s12", x1, x2), ("s1y", x1, y), ("s2y", x2, y), ("syy", y, y))])
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")
    b2 = F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")
    r2 = F.when((F.abs(det) > 1e-12) & (F.col("syy") > 0), (b1 * F.col("s1y") + b2 * F.col("s2y")) / det / F.col("syy"))
    return a.select(F.round(r2, 6).alias("linear_r2"))


def anova_r2(df: DataFrame, neuron: str, y: str) -> DataFrame:
    """Share of the variance of y that lies between neurons."""
    g = df.groupBy(neuron).agg(F.count(y).alias("n"), F.var_pop(y).alias("v"), F.avg(y).alias("m"))
    one = g.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("v")).alias("within"))
    total = df.agg(F.var_pop(y).alias("total"))
    return one.join(F.broadcast(total)).select(F.round(F.when(F.col("total") > 0, 1 - F.col("within") / F.col("all") / F.col("total")), 6).alias("anova_r2"))  # one row each


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores with the population deviation; constant columns are only centred."""
    fit = df.agg(*[f(c).alias(f"_{k}{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") == 0, 1.0).otherwise(F.col(f"_s{c}")) for c in cols}
    return df.join(F.broadcast(fit)).withColumns(scaled).drop(*[f"_{k}{c}" for c in cols for k in "ms"])  # one row


def knn_r2(points: DataFrame, id_col: str, y: str, xs: list[str], k: int, folds: int = 5) -> DataFrame:
    """Cross-validated R2 of a k-nearest-neighbour regression on a sample; folds are contiguous in the id's order."""
    p = points.withColumn("_f", F.ntile(folds).over(Window.orderBy(id_col)))
    a, b = p.alias("a"), p.alias("b")
    gap = F.round(sum(((F.col(f"a.{x}") - F.col(f"b.{x}")) * (F.col(f"a.{x}") - F.col(f"b.{x}")) for x in xs), F.lit(0.0)), 9)
    pairs = a.join(b, F.col("a._f") != F.col("b._f")).select(F.col("a._f").alias("f"), F.col(f"a.{id_col}").alias("p"), F.col(f"a.{y}").alias("y"), F.col(f"b.{y}").alias("yb"), gap.alias("d"), F.col(f"b.{id_col}").alias("q"))
    near = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("p").orderBy("d", "q"))).where(F.col("_r") <= k)
    fit = near.groupBy("f", "p").agg(F.first("y").alias("y"), F.avg("yb").alias("g"))
    fold = fit.groupBy("f").agg(F.sum((F.col("y") - F.col("g")) ** 2).alias("sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst"))
    return fold.agg(F.round(F.avg(1 - F.col("sse") / F.col("sst")), 6).alias("knn_r2"))


def adjusted_rand(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index from the contingency table."""
    keys = keys or []
    cells = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n"))

    def pairs(c: str) -> Column:
        return F.sum(F.col(c) * (F.col(c) - 1) / 2)

    def total(rows: DataFrame, name: str) -> DataFrame:
        return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(pairs("n").alias(name), F.sum("n").alias("all"))

    both = total(cells, "both")
    left = total(cells.groupBy(*keys, "_a").agg(F.sum("n").alias("n")), "left").drop("all")
    right = total(cells.groupBy(*keys, "_b").agg(F.sum("n").alias("n")), "right").drop("all")
    x = both.join(left, keys).join(right, keys) if keys else both.join(F.broadcast(left)).join(F.broadcast(right))  # one row each
    expected = F.col("left") * F.col("right") / (F.col("all") * (F.col("all") - 1) / 2)
    most = (F.col("left") + F.col("right")) / 2
    return x.select(*keys, F.round(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)), 6).alias("ari"))


def label_metrics(df: DataFrame, neuron: str, label: str) -> DataFrame:
    """ARI of neurons and of neurons merged by their dominant label, and mean purity."""
    top = dominant(df, neuron, label)
    merged = df.join(top.select(neuron, "dominant"), neuron)
    raw = adjusted_rand(df, neuron, label).withColumnRenamed("ari", "raw_ari")
    one = adjusted_rand(merged, "dominant", label).withColumnRenamed("ari", "merged_ari")
    purity = top.agg(F.round(F.avg("purity"), 6).alias("mean_purity"))
    return raw.join(F.broadcast(one)).join(F.broadcast(purity))  # one row each


#: Most points of a block of a chain, and rows and columns of what is compared at a time (so little that it stays in a core's cache).
CHAIN_BLOCK, TILE = 8192, (64, 512)


def _crossings(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[int, int]:
    """(crossings, pairs) of the segments of two blocks, each (x, y, is a segment's start); in the *same* one a pair counts once.

    A block's last point only ends a segment, and the first of the next block starts one. Two orientations
    of a pair share their differences and are those of the two-sided test, operation by operation.
    """
    crossings = pairs = 0
    height, width = TILE
    for r in range(0, a.shape[1] - 1, height):
        p = a[:, r : r + height + 1]
        m = p.shape[1] - 1
        turn_a = [np.diff(p[k])[:, None] for k in (0, 1)]
        for c in range(r // width * width if same else 0, b.shape[1] - 1, width):
            q = b[:, c : c + width + 1]
            n = q.shape[1] - 1
            starts = np.count_nonzero(p[2, :m]), np.count_nonzero(q[2, :n])
            near = same and c < r + height + 2
            both = None  # all pairs of the tile
            if near or starts != (m, n):
                both = (p[2, :m] > 0)[:, None] & (q[2, :n] > 0)
            if near:  # the second segment comes two or more after the first
                both &= c + np.arange(n) >= r + np.arange(m)[:, None] + 2
            dx, dy = q[0] - p[0][:, None], q[1] - p[1][:, None]
            one = turn_a[0] * dy[:m]
            one -= turn_a[1] * dx[:m]
            two = np.diff(q[0]) * dy[:, :n]
            two -= np.diff(q[1]) * dx[:, :n]
            left, right = one > 0, one < 0
            above, below = two > 0, two < 0
            cross = (left[:, :-1] & right[:, 1:]) | (right[:, :-1] & left[:, 1:])
            cross &= (above[:-1] & below[1:]) | (below[:-1] & above[1:])
            pairs += m * n if both is None else int(np.count_nonzero(both))
            crossings += int(np.count_nonzero(cross if both is None else cross & both))
    return crossings, pairs


def chain_crossings(points: DataFrame, order: str, x: str, y: str, block: int = CHAIN_BLOCK) -> DataFrame:
    """How many pairs of segments of a neuron chain cross.

    All pairs are compared. Pairs of blocks are dealt to the tasks, of which each holds a few blocks of points and counts.
    """
    at = positions(points.select(order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), [order])
    size = F.least(F.lit(block), F.greatest(F.lit(min(block, 512)), F.ceil(F.col("rows") / 32)))  # short chains make several blocks too
    # a block holds the first point of the next one too, which ends its last segment
    own = F.floor(F.col("position") / size)
    twice = F.when((F.col("position") % size == 0) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    point = F.struct("position", "x", "y")
    blocks = at.select(F.explode(twice).alias("block"), point.alias("p")).groupBy("block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    blocks = materialize(blocks.select("block", F.col("p.x").alias("x"), F.col("p.y").alias("y")), "chain-blocks")
    known = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    sides = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(known - 1))).alias("other"), "x", "y")
    sides = sides.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "x", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        crossings = pairs = 0
        for batch in batches:
            for row in range(batch.num_rows):
                i, j, no = (batch.column(k)[row].as_py() for k in range(3))
                xs, ys = (batch.column(k)[row].values for k in (3, 4))
                some = np.array([v.to_numpy(zero_copy_only=False) for v in (xs, ys)], float)  # null: NaN, which crosses nothing
                starts = np.append(~xs.is_null().to_numpy(zero_copy_only=False)[1:], False)  # a segment whose end is null is none
                here = np.vstack([some, starts])
                if i == j:
                    found = _crossings(here, here, True)
                elif held is not None and held[:2] == (i, j):
                    found = _between(held[2], here, j == i + 1)
                else:
                    held = (i, j, here)
                    continue
                held = None
                crossings, pairs = crossings + found[0], pairs + found[1]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (crossings, pairs)], names=["crossings", "pairs"])

    n = max(shuffle_partitions(points.sparkSession), min(known, 2000))
    dealt = sides.repartition(n, "i", "j").sortWithinPartitions("i", "j", "block")
    total = dealt.mapInArrow(count, "crossings long, pairs long")
    return total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("crossings", "pairs")])


def _between(a: np.ndarray, b: np.ndarray, neighbours: bool) -> tuple[int, int]:
    """(crossings, pairs) of two blocks; the last segment of one and the first of the next share a point and are no pair."""
    crossings, pairs = _crossings(a, b, False)
    if neighbours:
        less = _crossings(a[:, -2:], b[:, :2], False)
        return crossings - less[0], pairs - less[1]
    return crossings, pairs


def distance_spearman(points: DataFrame, id_col: str, u: list[str], v: list[str]) -> DataFrame:
    """Spearman correlation of distances in two spaces over all pairs of a bounded sample."""
    from lattiq.operators.windows import spearman

    a, b = points.alias("a"), points.alias("b")

    def gap(cols: list[str]) -> Column:
        return F.round(F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in cols), F.lit(0.0))), 9)

    pairs = a.join(b, F.col(f"a.{id_col}") < F.col(f"b.{id_col}")).select(F.lit(1).alias("k"), gap(u).alias("du"), gap(v).alias("dv"))
    return spearman(pairs, "du", "dv", ["k"]).select(F.round("rho", 6).alias("rho"), "n")


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> tuple[float, float] | None:
    """(U, two-sided p) by the normal approximation with tie correction; None under three values a side."""
    x = positions(df.where(F.col(group).isin(a, b)).select(group, value), [value])
    # equal values share the mean of their positions
    per = x.groupBy(value).agg(F.avg(F.col("position") + 1).alias("_r"), F.count_if(F.col(group) == a).alias("_a"), F.count(F.lit(1)).alias("_n"))
    one = per.agg(F.sum("_a").alias("a"), F.sum("_n").alias("n"), F.sum(F.col("_r") * F.col("_a")).alias("s"), F.sum(F.pow("_n", 3) - F.col("_n")).alias("t")).first()
    n1, n = one["a"] or 0, one["n"] or 0
    n2, ties = n - n1, one["t"]
    if min(n1, n2) < 3:
        return None
    u = one["s"] - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return u, 1.0
    z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return u, math.erfc(z / math.sqrt(2))


def worst(verdicts: DataFrame, col: str) -> DataFrame:
    """The most severe verdict."""
    level = F.when(F.col(col) == "FAIL", 3).when(F.col(col) == "WARN", 2).when(F.col(col) == "PASS", 1).otherwise(0)
    return verdicts.agg(F.element_at(F.array(*map(F.lit, ("SKIP", "PASS", "WARN", "FAIL"))), F.coalesce(F.max(level), F.lit(0)) + 1).alias("overall"))
