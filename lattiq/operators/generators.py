"""Synthetic tables. Values come from a hash of the row number and a seed, so they do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def uniform(name: str, seed: int, row: str = "id") -> Column:
    """A number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.col(row), F.lit(name), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def normal(name: str, seed: int) -> Column:
    """Box and Muller's transform of two uniform numbers."""
    return F.sqrt(-2 * F.ln(1 - uniform(name + ".a", seed))) * F.cos(2 * math.pi * uniform(name + ".b", seed))


def benchmark(spark: SparkSession, kind: str, rows: int = 2000, seed: int = 42) -> DataFrame:
    """id, features, and ground-truth columns named gt_*."""
    ids = spark.range(rows)
    u, v = uniform("u", seed), uniform("v", seed)
    if kind == "swiss_roll":
        t = 1.5 * math.pi * (1 + 2 * u)
        return ids.select("id", (t * F.cos(t)).alias("x"), (21 * v).alias("y"), (t * F.sin(t)).alias("z"), t.alias("gt_t"), (21 * v).alias("gt_height"))
    if kind == "s_curve":
        t = 3 * math.pi * (u - 0.5)
        return ids.select("id", F.sin(t).alias("x"), (2 * v).alias("y"), (F.signum(t) * (F.cos(t) - 1)).alias("z"), t.alias("gt_t"), (2 * v).alias("gt_height"))
    if kind == "helix":
        t = 4 * math.pi * u
        return ids.select("id", F.cos(t).alias("x"), F.sin(t).alias("y"), (t / 4).alias("z"), t.alias("gt_t"))
    if kind == "torus":
        a, b = 2 * math.pi * u, 2 * math.pi * v
        return ids.select("id", ((2 + 0.7 * F.cos(b)) * F.cos(a)).alias("x"), ((2 + 0.7 * F.cos(b)) * F.sin(a)).alias("y"), (0.7 * F.sin(b)).alias("z"), a.alias("gt_u"), b.alias("gt_v"))
    if kind == "blobs":
        label = (F.col("id") % 5).cast("int")
        return ids.select("id", *[(F.sin(label * 7.0 + 3 * d) * 8 + normal(f"f{d}", seed)).alias(f"f{d}") for d in range(5)], label.alias("gt_label"))
    if kind == "noisy_plane":
        return ids.select("id", u.alias("u_signal"), v.alias("v_signal"), *[uniform(f"n{d}", seed).alias(f"noise_{d}") for d in range(4)], u.alias("gt_u"), v.alias("gt_v"))
    if kind == "uniform_cube":
        return ids.select("id", *[uniform(f"f{d}", seed).alias(f"f{d}") for d in range(5)])
    if kind == "space_filling":
        return ids.select("id", u.alias("x"), v.alias("y"))
    raise ValueError(f"unknown benchmark {kind!r}")


def from_schema(spark: SparkSession, schema: dict[str, dict], rows: int, seed: int) -> DataFrame:
    """Columns by spec: {"type": "int" | "float", "min", "max"}, {"type": "normal", "mean", "std"}, {"type": "category", "values"}."""
    cols = []
    for name, s in schema.items():
        u = uniform(name, seed)
        if s["type"] == "int":
            c = (s["min"] + F.floor(u * (s["max"] - s["min"] + 1))).cast("int")
        elif s["type"] == "float":
            c = s["min"] + u * (s["max"] - s["min"])
        elif s["type"] == "normal":
            c = s["mean"] + s["std"] * normal(name, seed)
        elif s["type"] == "category":
            c = F.element_at(F.array(*map(F.lit, s["values"])), (F.floor(u * len(s["values"])) + 1).cast("int"))
        else:
            raise ValueError(f"unknown type {s['type']!r}")
        cols.append(F.when(uniform(name + ".null", seed) >= s.get("null_share", 0.0), c).alias(name))
    return spark.range(rows).select("id", *cols)


def trips(spark: SparkSession, rows: int = 800, outliers: int = 24, subgroup: int = 32, seed: int = 42) -> DataFrame:
    """Trips with injected anomalies: _anomaly_label 0 clean, 1 outlier (costs x 8 to 15), 2 a costly subgroup."""
    pick = F.element_at(F.array(*map(F.lit, ("domestic", "europe", "overseas"))), (F.floor(uniform("dest", seed) * 3) + 1).cast("int"))
    base = F.when(F.col("destination_category") == "domestic", 300).when(F.col("destination_category") == "europe", 1500).otherwise(7000)
    t = spark.range(rows).withColumn("destination_category", pick)
    t = t.withColumn("purpose", F.element_at(F.array(*map(F.lit, ("client", "training", "conference"))), (F.floor(uniform("purpose", seed) * 3) + 1).cast("int")))
    t = t.withColumns({"distance_km": base * (0.6 + 0.8 * uniform("dist", seed)), "duration_days": (F.floor(uniform("days", seed) * 6) + 1).cast("int"), "_h": F.xxhash64("id", F.lit(seed))})
    odd = t.select("id", "_h").orderBy("_h", "id").limit(outliers + subgroup)
    packed = odd.agg(F.array_sort(F.collect_list(F.struct("_h", "id"))).alias("all")).select(F.posexplode("all").alias("p", "o"))  # the injected few
    label = packed.select(F.col("o.id").alias("id"), F.when(F.col("p") < outliers, 1).otherwise(2).alias("_label"))
    t = t.join(label, "id", "left").withColumn("_anomaly_label", F.coalesce("_label", F.lit(0)))
    factor = F.when(F.col("_anomaly_label") == 1, 8 + 7 * uniform("factor", seed)).when(F.col("_anomaly_label") == 2, 2.5).otherwise(1.0)
    t = t.withColumns({"transport_cost": (F.col("distance_km") * 0.2 * factor * (0.9 + 0.2 * uniform("tc", seed))).cast("int"), "accommodation_cost": (F.col("duration_days") * 110 * (0.8 + 0.4 * uniform("ac", seed))).cast("int")})
    t = t.withColumn("total_cost", F.col("transport_cost") + F.col("accommodation_cost"))
    return t.select("id", "destination_category", "purpose", "distance_km", "duration_days", "transport_cost", "accommodation_cost", "total_cost", (F.col("transport_cost") / F.col("distance_km")).alias("cost_per_km"), "_anomaly_label")
