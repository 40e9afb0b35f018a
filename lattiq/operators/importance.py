"""Permutation importance: what a model's error gains when a column is shuffled within itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lattiq.operators.sequences import positions
from lattiq.session import materialize


def shuffle_order(row_id: Column, feature: Column, repeat: Column) -> Column:
    """What orders the rows of a shuffle: an MD5 of id, feature and repeat."""
    return F.md5(F.concat_ws(":", row_id.cast("string"), feature, repeat.cast("string")))


def permutation_importance(df: DataFrame, id_col: str, features: list[str], target: str, predict: Callable[[dict[str, Column]], Column], repeats: int = 3) -> DataFrame:
    """(feature, baseline, importance, spread): mean and population deviation, over repeats, of the gain in mean squared error.

    All features and repeats go through one range sort and one join: the row at a place of
    the order by id takes the value of the row at that place of the order by hash.
    """
    rows = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))
    placed = materialize(positions(rows, ["id"]).drop("rows"), "importance-rows")
    n = F.greatest(F.col("rows") / (len(features) * repeats), F.lit(1))
    long = rows.select("id", *features).unpivot(["id"], features, "feature", "value").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    long = long.withColumn("_h", shuffle_order(F.col("id"), F.col("feature"), F.col("repeat")))
    ranked = positions(long.select("feature", "repeat", "_h", "id", "value"), ["feature", "repeat", "_h", "id"])
    # every feature and repeat has all rows, so the place within it is the remainder
    given = ranked.select("feature", "repeat", F.col("value").alias("_shuffled"), F.pmod(F.col("position"), n.cast("long")).alias("position"))
    met = placed.join(given, "position")
    changed = {f: F.when(F.col("feature") == f, F.col("_shuffled")).otherwise(F.col(f)) for f in features}
    error = (F.col("_y") - predict(changed)) * (F.col("_y") - predict(changed))
    own = (F.col("_y") - predict({f: F.col(f) for f in features})) * (F.col("_y") - predict({f: F.col(f) for f in features}))
    per = met.groupBy("feature", "repeat").agg(F.avg(error).alias("e"), F.avg(own).alias("b"))
    return per.groupBy("feature").agg(F.avg("b").alias("baseline"), F.avg(F.col("e") - F.col("b")).alias("importance"), F.stddev_pop(F.col("e") - F.col("b")).alias("spread"))
