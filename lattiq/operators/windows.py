"""Order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_of_each(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Rows whose *col* is the greatest of their key; the maximum travels, not the rows."""
    top = df.groupBy(*keys).agg(F.max(col).alias("_top"))
    return df.join(top, keys).where(F.col(col) == F.col("_top")).drop("_top")


def average_rank(value: str, *keys: str) -> Column:
    """Ranks with ties averaged, within keys."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Spearman correlation by key; null where a side is constant."""
    ranked = df.select(*keys, average_rank(x, *keys).alias("rx"), average_rank(y, *keys).alias("ry"))
    agg = ranked.groupBy(*keys) if keys else ranked.groupBy()
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return agg.agg((F.covar_pop("rx", "ry") / F.when(spread > 0, spread)).alias("rho"), F.count(F.lit(1)).alias("n"))


def relative_to_first(value: str, keys: list[str], order: list, floor: float = 1e-10) -> Column:
    """The value over its first one."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return F.col(value) / F.greatest(first, F.lit(floor))


def early_stopping(df: DataFrame, value: str, keys: list[str], order: list, window: int, patience: int) -> DataFrame:
    """Moving average over full windows, its best so far, evaluations since the best, and the stop flag."""
    w = Window.partitionBy(*keys).orderBy(*order)
    full = F.row_number().over(w) >= window
    df = df.withColumn("_no", F.row_number().over(w)).withColumn("moving", F.when(full, F.avg(value).over(w.rowsBetween(1 - window, 0))))
    df = df.withColumn("best", F.min("moving").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.min("moving").over(w.rowsBetween(Window.unboundedPreceding, -1))
    improved = F.col("moving").isNotNull() & (before.isNull() | (F.col("moving") < before))
    df = df.withColumn("_at", F.max(F.when(improved, F.col("_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("since_best", F.when(F.col("moving").isNotNull(), F.col("_no") - F.col("_at"))).withColumn("stop", F.coalesce(F.col("since_best") >= patience, F.lit(False))).drop("_no", "_at")


def best_so_far(value: str, keys: list[str], order: list) -> Column:
    return F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_normalised(df: DataFrame, value: str, group: str, keys: list[str]) -> DataFrame:
    """Values over the range seen up to their generation, clipped to [0, 1.1]; tiny ranges count as 1."""
    per = df.groupBy(*keys, group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    per = per.select(*keys, group, F.min("_lo").over(w).alias("_lo"), F.max("_hi").over(w).alias("_hi"))
    span = F.when(F.col("_hi") - F.col("_lo") < 1e-9, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.1), (F.col(value) - F.col("_lo")) / span))
    return df.join(per, [*keys, group]).withColumn("normalised", scaled).drop("_lo", "_hi")


def resample(df: DataFrame, key: str, x: str, y: str, points: int) -> DataFrame:
    """Linear resampling of each key's sequence, x in [0, 1], to evenly spaced points."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k / float(points - 1))).alias("g")
    rows = df.select(key, F.col(x).alias("g"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    asked = df.select(key).distinct().select(key, grid).withColumns({"_x": F.lit(None).cast("double"), "_y": F.lit(None).cast("double")})
    both = rows.unionByName(asked)
    w = Window.partitionBy(key).orderBy("g", F.col("_x").isNull())
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({n: F.last(c, True).over(up) for n, c in (("x0", "_x"), ("y0", "_y"))} | {n: F.first(c, True).over(down) for n, c in (("x1", "_x"), ("y1", "_y"))})
    t = (F.col("g") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    value = F.when(F.col("x0").isNull(), F.col("y1")).when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0")).otherwise(F.col("y0") + t * (F.col("y1") - F.col("y0")))
    return both.where("_x IS NULL").select(key, F.col("g").alias("at"), value.alias("value"))


def prefix_windows(df: DataFrame, seq: str, shares: list[float]) -> DataFrame:
    """One row for each share of the sequence's beginning; at least two points."""
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    out = df.select("*", share)
    size = F.greatest(F.lit(2), F.bround(F.col("share") * F.size(seq)).cast("int"))
    return out.withColumn("prefix", F.slice(seq, F.lit(1), size))


def saturation(df: DataFrame, keys: list[str], budget: str, value: str, least: float = 0.02) -> DataFrame:
    """Gain from each budget to the next, and whether every further step gains less than *least*."""
    w = Window.partitionBy(*keys).orderBy(budget)
    gain = (F.col(value) - F.lead(value).over(w)) / F.col(value)
    df = df.withColumn("gain", gain)
    rest = F.max("gain").over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("saturated", F.coalesce(rest < least, F.lit(True)))


def presence_gaps(df: DataFrame, keys: list[str], step: str) -> DataFrame:
    """First and last step of each key, and how many between them are missing."""
    g = df.groupBy(*keys).agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count_distinct(step).alias("present"))
    return g.withColumn("gaps", F.col("last") - F.col("first") + 1 - F.col("present"))
