"""Rows of results joined to the image files that exist for them, for training on images of maps.

Files are listed, never opened. Each place an image may lie in is a pattern over paths; a row
takes the file of the first place that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattiq.operators.profile import rule_label

#: Places of a map's image, in order of preference; the groups are data set and uid.
PLACES = (
    r"/([^/]+)/results/EA/maps_dataset/rgb/([^/]+)_rgb\.png$",
    r"/([^/]+)/results/EA/visualizations/([^/]+)_rgb\.png$",
    r"/([^/]+)/results/EA/([^/]+)_rgb\.png$",
)
SAMPLE = ("filepath", "quality_score", "map_width", "uid", "label_source", "dataset_name", "dead_neuron_ratio", "topographic_error", "best_mqe")


def image_files(spark: SparkSession, root: str, places: tuple[str, ...] = PLACES, names: str = "*.png") -> DataFrame:
    """dataset_name, uid and filepath of the preferred image of each map below *root*; empty files do not count."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    found = listed.where("length > 0").select("path", F.posexplode(F.array(*[F.struct(F.regexp_extract("path", p, 1).alias("d"), F.regexp_extract("path", p, 2).alias("u")) for p in places])).alias("place", "at"))
    named = found.where("at.u <> ''").select(F.col("at.d").alias("dataset_name"), F.col("at.u").alias("uid"), F.struct("place", "path").alias("at"))
    return named.groupBy("dataset_name", "uid").agg(F.min("at")["path"].alias("filepath"))


def with_map_size(rows: DataFrame, col: str = "map_size") -> DataFrame:
    """map_width and map_height from a text such as ``[10, 12]``; 0 and 0 where it is none."""
    sides = [F.regexp_extract(F.coalesce(F.col(col), F.lit("")), r"^\s*\[\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\]\s*$", k) for k in (1, 2)]
    return rows.withColumns({n: F.coalesce(F.when(s != "", s).try_cast("int"), F.lit(0)) for n, s in zip(("map_width", "map_height"), sides, strict=True)})


def labelled_images(rows: DataFrame, images: DataFrame, unlabelled: bool = False) -> DataFrame:
    """The training table: rows that have an image, with a label by rule and its source.

    *rows* need dataset_name, uid, topographic_error and dead_neuron_ratio. Rows that no rule
    labels are left out unless *unlabelled*. Columns of the training table that *rows* lack are left out.
    """
    label, source = rule_label(F.col("topographic_error"), F.col("dead_neuron_ratio"))
    scored = rows.withColumns({"quality_score": label, "label_source": source})
    if not unlabelled:
        scored = scored.where("quality_score IS NOT NULL")
    own = scored.drop("filepath")
    joined = own.join(images.select("dataset_name", F.col("uid").alias("_uid"), "filepath"), (own["uid"].cast("string") == F.col("_uid")) & (own["dataset_name"] == images["dataset_name"])).drop("_uid").drop(images["dataset_name"])
    return joined.select(*[c for c in SAMPLE if c in joined.columns])


def coverage(rows: DataFrame, images: DataFrame) -> DataFrame:
    """A row a data set: its rows and how many of them have an image."""
    has = images.select("dataset_name", "uid", F.lit(1).alias("_has"))
    return rows.select("dataset_name", F.col("uid").cast("string").alias("uid")).join(has, ["dataset_name", "uid"], "left").groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("_has").alias("n_images"))


def estimated_ranges(rows: DataFrame, mean: str, std: str, groups: list[list[str]]) -> DataFrame:
    """Estimated low and high of a value of which only mean and deviation are known, per row.

    They are two deviations from the mean, the low one at least 0. A row without a mean or
    deviation of its own takes those of the first of *groups* in which any row has both: the mean of means, and
    the deviation within and between rows together. `from_group` counts from 0 for the row
    itself; it is null, with the estimates, where no group has any.
    """
    m, s = F.col(mean), F.col(std)
    known = rows.where(m.isNotNull() & s.isNotNull() & ~F.isnan(m) & ~F.isnan(s))
    both = m.isNotNull() & s.isNotNull() & ~F.isnan(m) & ~F.isnan(s)
    found = [F.when(both, F.struct(F.lit(0).alias("from_group"), m.cast("double").alias("mean"), s.cast("double").alias("std")))]
    out = rows
    for k, keys in enumerate(groups, 1):
        middle, spread = F.avg(mean).alias("mean"), F.sqrt(F.avg(s * s) + F.var_pop(mean)).alias("std")
        of = known.groupBy(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)]).agg(F.struct(F.lit(k).alias("from_group"), middle, spread).alias(f"_of{k}"))
        if not keys:
            of = of.where(f"_of{k}.mean IS NOT NULL")
        same = F.lit(True)
        for n, c in enumerate(keys):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{n}"))
        out = out.join(of if keys else F.broadcast(of), same, "left").drop(*[f"_k{n}" for n in range(len(keys))])  # no keys: one row
        found.append(F.col(f"_of{k}"))
    out = out.withColumn("_est", F.coalesce(*found)).drop(*[f"_of{k}" for k in range(1, len(groups) + 1)])
    low, high = F.col("_est.mean") - 2 * F.col("_est.std"), F.col("_est.mean") + 2 * F.col("_est.std")
    return out.withColumns({"from_group": F.col("_est.from_group"), "est_low": F.greatest(F.lit(0.0), low), "est_high": high}).withColumn("est_low", F.when(F.col("from_group").isNotNull(), F.col("est_low"))).drop("_est")
