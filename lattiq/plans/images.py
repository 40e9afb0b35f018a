"""Queries: results joined to image files, and estimates of metrics that were not stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattiq.plans.registry import query
from lattiq.session import scratch_root, shuffle_partitions, table
from lattiq.sources import image_sets as I
from lattiq.sources.sinks import write_files

#: Small text files stand for images, in the first two of the usual places.
WRITTEN = {40: "maps_dataset/rgb", 60: "visualizations"}
_ROWS = """r AS (SELECT p_partkey AS uid, 'd' || (p_size % 5) AS dataset_name, p_size AS side, round(p_size / 40.0::DOUBLE, 6) AS te, round((p_partkey % 41) / 100.0::DOUBLE, 6) AS dead, round(p_retailprice / 100, 4) AS mqe FROM part)"""


def results(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("uid"),
        F.concat(F.lit("d"), F.col("p_size") % 5).alias("dataset_name"),
        F.concat(F.lit("["), F.col("p_size"), F.lit(", "), F.col("p_size") + 1, F.lit("]")).alias("map_size"),
        F.round(F.col("p_size") / 40.0, 6).alias("topographic_error"),
        F.round((F.col("p_partkey") % 41) / 100.0, 6).alias("dead_neuron_ratio"),
        F.round(F.col("p_retailprice") / 100, 4).alias("best_mqe"),
    )


def images(spark, d):
    """Every 40th part has a file in the first place, every 60th one in the second."""
    root = f"{scratch_root(spark)}/images-{uuid.uuid4().hex}"
    places = F.filter(F.array(*[F.when(F.col("uid") % every == 0, F.lit(place)) for every, place in WRITTEN.items()]), lambda x: x.isNotNull())
    rows = results(spark, d).select("dataset_name", "uid", "map_size", F.explode(places).alias("place"))
    path = F.concat("dataset_name", F.lit("/results/EA/"), "place", F.lit("/"), "uid", F.lit("_rgb.png"))
    write_files(rows.select(path.alias("path"), F.col("map_size").alias("value")).repartition(shuffle_partitions(spark), "path"), root)
    return I.image_files(spark, root)


@query(f"""WITH {_ROWS} SELECT uid, dataset_name, side AS map_width, CASE WHEN dead < 0.05 AND te < 0.10 THEN 0.9 ELSE 0.1 END::DOUBLE AS quality_score,
 CASE WHEN dead > 0.30 THEN 'auto_dead' WHEN te > 0.50 THEN 'auto_te' ELSE 'auto_good' END AS label_source, mqe AS best_mqe, CASE WHEN uid % 40 = 0 THEN 'best' ELSE 'spare' END AS place
FROM r WHERE (uid % 40 = 0 OR uid % 60 = 0) AND (dead > 0.30 OR te > 0.50 OR (dead < 0.05 AND te < 0.10))""")
def p18_labelled_images(spark, d):
    got = I.labelled_images(I.with_map_size(results(spark, d)), images(spark, d))
    return got.select("uid", "dataset_name", "map_width", "quality_score", "label_source", "best_mqe", F.when(F.contains("filepath", F.lit("/maps_dataset/rgb/")), "best").otherwise("spare").alias("place"))


@query(f"WITH {_ROWS} SELECT dataset_name, count(*) AS n_rows, count(*) FILTER (uid % 40 = 0 OR uid % 60 = 0) AS n_images FROM r GROUP BY 1")
def p18_image_coverage(spark, d):
    return I.coverage(results(spark, d), images(spark, d))


_MISSING = "l_orderkey % 3 = 0 OR l_suppkey % 4 = 1"


@query(f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS g, l_returnflag AS f, CASE WHEN NOT ({_MISSING}) THEN l_quantity::DOUBLE END AS m, l_discount::DOUBLE * 100 AS s FROM lineitem),
a AS (SELECT g, avg(m) AS m, sqrt(avg(s * s) + var_pop(m)) AS s FROM x WHERE m IS NOT NULL GROUP BY 1), b AS (SELECT f, avg(m) AS m, sqrt(avg(s * s) + var_pop(m)) AS s FROM x WHERE m IS NOT NULL GROUP BY 1),
y AS (SELECT k, n, CASE WHEN x.m IS NOT NULL THEN 0 WHEN a.m IS NOT NULL THEN 1 ELSE 2 END AS from_group, coalesce(x.m, a.m, b.m) AS m, CASE WHEN x.m IS NOT NULL THEN x.s WHEN a.m IS NOT NULL THEN a.s ELSE b.s END AS s FROM x LEFT JOIN a USING (g) LEFT JOIN b USING (f))
SELECT k, n, from_group, round(greatest(0, m - 2 * s), 6)::DOUBLE AS est_low, round(m + 2 * s, 6) AS est_high FROM y""")
def p18_estimated_ranges(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("f"), F.when(~F.expr(_MISSING), F.col("l_quantity").cast("double")).alias("m"), (F.col("l_discount").cast("double") * 100).alias("s")
    )
    got = I.estimated_ranges(x, "m", "s", [["g"], ["f"]])
    return got.select("k", "n", "from_group", F.round("est_low", 6).alias("est_low"), F.round("est_high", 6).alias("est_high"))
