"""Exact percentiles by repeated histograms.

A pass counts the values of each key in bins of a range and notes every bin's smallest and
largest value. The bin that holds a rank is the range of the next pass, so a pass looks only at
the rows of those bins, and its result has at most *bins* rows for each key and rank. A rank
is found when its bin holds a single value, or so few that they are sorted as one short
array. No task ever keeps the values of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lattiq.session import materialize


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys], F.lit(True))


def percentiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 4096, gather: int = 4096) -> DataFrame:
    """(keys, q): linearly interpolated percentiles of the non-null values of each key, as an array in the order of *probs*."""
    data = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ends = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ends = ends.where("_n > 0").withColumn("_n", F.col("_n").cast("double"))
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    state = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").cast("long").alias("_size"))
    state = materialize(state, "ranks")
    names = [f"_{k}" for k in keys]
    out = [*names, "_rank", "_lo"]
    found = state.where("_lo = _hi").select(*out)
    short = state.where(F.lit(False))
    while True:
        short = short.unionByName(state.where((F.col("_lo") < F.col("_hi")) & (F.col("_size") <= gather)))
        open_ranks = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_size") > gather))
        if open_ranks.isEmpty():
            break
        ranges = open_ranks.select(*names, "_lo", "_hi", "_below").distinct()
        hit = data.join(ranges, _same(data, ranges, keys) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        # halves first: a range may be wider than the largest double
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        edge = F.when(F.col("_v") == F.col("_hi"), bins).when(F.col("_v") == F.col("_lo"), -1)
        bin_no = F.coalesce(edge, F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int"), F.lit(0))
        counts = hit.groupBy(*names, "_lo", "_below", bin_no.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        order = Window.partitionBy(*names, "_lo").orderBy("_bin")  # at most bins + 2 rows each
        placed = counts.withColumn("_to", F.col("_below") + F.sum("_c").over(order))
        placed = placed.select(*[F.col(n).alias(f"p{n}") for n in names], F.col("_lo").alias("p_lo"), "_first", "_last", (F.col("_to") - F.col("_c")).alias("_from"), "_to")
        match = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"p{n}")) for n in names], F.col("_lo") == F.col("p_lo"))
        step = open_ranks.join(placed, match & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        state = materialize(step.select(*names, "_rank", F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), F.col("_from").alias("_below"), (F.col("_to") - F.col("_from")).alias("_size")), "ranks")
        found = found.unionByName(state.where("_lo = _hi").select(*out))
    ranges = short.groupBy(*names, "_lo", "_hi", "_below").agg(F.collect_list("_rank").alias("_ranks"))
    hit = data.join(ranges, _same(data, ranges, keys) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    sorted_values = hit.groupBy(*names, "_lo", "_below").agg(F.first("_ranks").alias("_ranks"), F.sort_array(F.collect_list("_v")).alias("_vs"))  # at most *gather* values
    picked = sorted_values.select(*names, "_below", "_vs", F.explode("_ranks").alias("_rank"))
    found = found.unionByName(picked.select(*names, "_rank", F.element_at("_vs", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_lo")))
    at = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))  # a few ranks a key

    def between(x):
        low, high = F.col("_at")[F.floor(x).cast("long")], F.col("_at")[F.ceil(x).cast("long")]
        return F.when(low == high, low).otherwise(low + (high - low) * (x - F.floor(x)))

    joined = ends.join(at, _same(ends, at, keys))
    return joined.select(*keys, F.array(*[between(x) for x in place]).alias("q"))
