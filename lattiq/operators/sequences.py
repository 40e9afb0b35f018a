"""Preparation of sequences and rows for downstream models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq.operators.windows import relative_to_first


def quartile_of(df: DataFrame, value: str, id_col: str) -> DataFrame:
    """ntile(4) in the order of (value, id), by range-partitioned positions: no single task ranks all rows."""
    return positions(df, [value, id_col]).withColumn("quartile", tile(F.col("position"), F.col("rows"), 4)).drop("position", "rows")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """*df* with position (from 0, in total order) and rows, from one range sort and a count a partition."""
    from lattiq.session import materialize

    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).orderBy("_p").collect()  # a row a partition
    before, total = {}, 0
    for r in sizes:
        before[r["_p"]] = total
        total += r["_n"]
    if not sizes:
        return ranged.drop("_p").withColumns({"position": F.lit(0).cast("long"), "rows": F.lit(0).cast("long")})
    start = F.create_map(*[F.lit(v) for p, n in before.items() for v in (p, n)])
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumns({"position": (start[F.col("_p")] + inside).cast("long"), "rows": F.lit(total).cast("long")}).drop("_p")


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """ntile from a position: the first rows % tiles tiles hold one row more."""
    small, more = F.floor(rows / tiles), rows % tiles
    edge = more * (small + 1)
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(more + F.floor((position - edge) / F.greatest(small, F.lit(1)))).cast("int") + 1


def oversample(df: DataFrame, chosen: Column, times: int) -> DataFrame:
    """Rows with a copy number; chosen rows occur *times* times."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(chosen, F.lit(times - 1)).otherwise(0))))


def normalise_checkpoints(df: DataFrame, key: str, order: str) -> DataFrame:
    """Six features of each checkpoint: progress, relative error, te, dead, relative rate and radius; short runs go."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(key)
    x = df.join(enough, key, "left_semi")
    return x.select(
        key,
        "progress",
        relative_to_first("mqe", [key], [order]).alias("mqe_rel"),
        F.col("topographic_error").alias("te"),
        F.col("dead_neuron_ratio").alias("dead"),
        relative_to_first("learning_rate", [key], [order]).alias("lr_rel"),
        relative_to_first("radius", [key], [order]).alias("radius_rel"),
    )


def split(df: DataFrame, id_col: str, stratum: str | None = None, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """train, val or test by the rank of the id's hash within its stratum; a split is by individual."""
    keys = [stratum] if stratum else []
    ids = df.select(id_col, *keys).distinct().withColumn("_h", F.md5(F.col(id_col).cast("string")))
    if keys:
        w = Window.partitionBy(*keys)
        ids = ids.withColumns({"position": F.row_number().over(w.orderBy("_h", id_col)) - 1, "rows": F.count(F.lit(1)).over(w)})
    else:
        ids = positions(ids, ["_h", id_col])

    def below(share: float) -> Column:  # of the percent rank, in whole numbers
        return (F.col("rows") == 1) | (F.col("position") * 1000 < round(1000 * share) * (F.col("rows") - 1))

    part = F.when(below(shares[0]), "train").when(below(sum(shares)), "val").otherwise("test")
    return df.join(ids.select(id_col, part.alias("split")), id_col)


def advantage(df: DataFrame, deltas: list[str]) -> DataFrame:
    """Sum of deltas over their deviations, scaled to [0, 1]; a constant sum becomes one half."""
    sd = df.agg(*[F.stddev_pop(c).alias(f"_{c}") for c in deltas])
    raw = sum((F.col(c) / F.when(F.coalesce(F.col(f"_{c}"), F.lit(0.0)) < 1e-10, 1.0).otherwise(F.col(f"_{c}")) for c in deltas), F.lit(0.0))
    x = df.join(F.broadcast(sd)).withColumn("_raw", raw).drop(*[f"_{c}" for c in deltas])  # one row
    span = x.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return x.join(F.broadcast(span)).withColumn("advantage", scaled).drop("_raw", "_lo", "_hi")


def badness(mqe_rel: Column, te: Column, dead: Column) -> Column:
    return (1 - mqe_rel) + te + 0.5 * dead


def recommendation(mqe: Column, te: Column, dead: Column) -> Column:
    """Bands of the predicted cost: above 1 terminate, above one half caution."""
    cost = mqe + te + 0.5 * dead
    return F.when(cost > 1.0, "terminate").when(cost > 0.5, "caution").otherwise("continue")


def pad(seq: Column, length: int, value: Column) -> Column:
    """A sequence with *value* appended up to *length*; longer ones are cut."""
    return F.slice(F.concat(seq, F.array_repeat(value, F.greatest(F.lit(0), F.lit(length) - F.size(seq)))), 1, length)


def standardise(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """Scale by mean and population deviation of the training rows; a constant column is only centred."""
    fit = df.where(train).agg(*[f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}
    return df.join(F.broadcast(fit)).withColumns(scaled).drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def batches_by_size(df: DataFrame, size: str, batch: int) -> DataFrame:
    """How many batches each group of equally sized items makes."""
    return df.groupBy(size).agg(F.count(F.lit(1)).alias("items")).withColumn("batches", F.ceil(F.col("items") / batch))
