"""Neuron grids: coordinates, neighbours, planes, regions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Grid:
    m: int
    n: int
    topology: str = "hex"  # anything else is square

    @property
    def size(self) -> int:
        return self.m * self.n

    @property
    def hex(self) -> bool:
        return self.topology == "hex"

    def cube(self, i: Column, j: Column) -> tuple[Column, Column, Column]:
        q = j - F.floor(i / 2)
        return q, -q - i, i

    def xy(self, i: Column, j: Column) -> tuple[Column, Column]:
        if not self.hex:
            return i.cast("double"), j.cast("double")
        return j + 0.5 * (i % 2), i * float(np.sqrt(3) / 2)

    def steps(self, ai: Column, aj: Column, bi: Column, bj: Column) -> Column:
        """Grid distance: cube distance on hex maps, Chebyshev on square ones."""
        if not self.hex:
            return F.greatest(F.abs(ai - bi), F.abs(aj - bj)).cast("double")
        a, b = self.cube(ai, aj), self.cube(bi, bj)
        return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0)) / 2

    def neurons(self, spark: SparkSession) -> DataFrame:
        g = spark.range(self.size, numPartitions=1).select(F.col("id").cast("int").alias("nid"))
        g = g.withColumns({"i": F.floor(F.col("nid") / self.n).cast("int"), "j": (F.col("nid") % self.n).cast("int")})
        x, y = self.xy(F.col("i"), F.col("j"))
        return g.select("nid", "i", "j", F.concat_ws("_", "i", "j").alias("neuron_key"), x.alias("x"), y.alias("y"))

    def edges(self, spark: SparkSession, rook: bool = False) -> DataFrame:
        """(a, b) for each ordered pair of neighbours: hex 6, square 4; *rook* forces 4."""
        flat = [(0, 1), (0, -1), (1, 0), (-1, 0)]
        if self.hex and not rook:
            even, odd = flat + [(1, -1), (-1, -1)], flat + [(1, 1), (-1, 1)]
        else:
            even = odd = flat

        def offsets(pairs: list[tuple[int, int]]) -> Column:
            return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in pairs])

        g = self.neurons(spark).select("nid", "i", "j", F.explode(F.when(F.col("i") % 2 == 0, offsets(even)).otherwise(offsets(odd))).alias("o"))
        g = g.select("nid", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"))
        return g.where(f"i >= 0 AND i < {self.m} AND j >= 0 AND j < {self.n}").select(F.col("nid").alias("a"), (F.col("i") * self.n + F.col("j")).alias("b"))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def u_matrix(codebook: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean distance of each neuron's weights to its neighbours'."""
    a, b = codebook.alias("a"), codebook.alias("b")
    e = edges.alias("e").join(a, F.col("e.a") == F.col("a.nid")).join(b, F.col("e.b") == F.col("b.nid"))
    return e.groupBy(F.col("e.a").alias("nid")).agg(F.avg(euclid(F.col("a.w"), F.col("b.w"))).alias("u"))


def u_matrix_metrics(codebook: DataFrame, grid: Grid) -> DataFrame:
    """Mean, deviation and maximum of the rook U-matrix whose divisor is 4 less one for each border."""
    spark = codebook.sparkSession
    a, b = codebook.alias("a"), codebook.alias("b")
    e = grid.edges(spark, rook=True).alias("e").join(a, F.col("e.a") == F.col("a.nid")).join(b, F.col("e.b") == F.col("b.nid"))
    total = e.groupBy(F.col("e.a").alias("nid")).agg(F.sum(euclid(F.col("a.w"), F.col("b.w"))).alias("s"))
    i, j = F.floor(F.col("nid") / grid.n), F.col("nid") % grid.n
    borders = sum(((c == v).cast("int") for c, v in ((i, 0), (j, 0))), F.lit(0)) + ((i == grid.m - 1) & F.lit(grid.m > 1)).cast("int") + ((j == grid.n - 1) & F.lit(grid.n > 1)).cast("int")
    u = total.select((F.col("s") / (4 - borders)).alias("u"))
    return u.agg(F.round(F.avg("u"), 6).alias("u_mean"), F.round(F.stddev_pop("u"), 6).alias("u_std"), F.round(F.max("u"), 6).alias("u_max"))


def planes(codebook: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, feature, v): one component plane a feature."""
    labels = F.array(*map(F.lit, names))
    return codebook.select("i", "j", F.posexplode("w").alias("d", "v")).select("i", "j", labels[F.col("d")].alias("feature"), "v")


def spatial_stats(pl: DataFrame) -> DataFrame:
    """Per plane: gradients, roughness, Moran's I (rook), strict 3 x 3 extrema. All windows stay within a plane."""
    row, col = Window.partitionBy("feature", "i").orderBy("j"), Window.partitionBy("feature", "j").orderBy("i")

    def slope(w) -> Column:
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        inner = (after - before) / 2
        return F.coalesce(inner, after - F.col("v"), F.col("v") - before, F.lit(0.0))

    whole = Window.partitionBy("feature")
    x = pl.withColumns({"gx": slope(row), "gy": slope(col), "z": F.col("v") - F.avg("v").over(whole)})
    x = x.withColumns({"right": F.lead("z").over(row), "down": F.lead("z").over(col)})
    three = row.rowsBetween(-1, 1)
    x = x.withColumns({"rmax": F.max("v").over(three), "rmin": F.min("v").over(three)})
    tall = col.rowsBetween(-1, 1)
    x = x.withColumns({"hi": F.max("rmax").over(tall), "lo": F.min("rmin").over(tall)})
    size = F.hypot("gy", "gx")
    got = x.groupBy("feature").agg(
        F.avg(size).alias("g"),
        F.max(size).alias("gm"),
        F.stddev_pop("v").alias("sd"),
        F.sum(F.col("z") * F.col("z")).alias("zz"),
        F.coalesce(F.sum(F.col("z") * F.col("down")), F.lit(0.0)).alias("cross_down"),
        F.coalesce(F.sum(F.col("z") * F.col("right")), F.lit(0.0)).alias("cross_right"),
        (F.count("right") + F.count("down")).alias("pairs"),
        F.count("v").alias("cells"),
        F.count_if((F.col("v") == F.col("hi")) & (F.col("hi") > F.col("lo"))).alias("n_local_maxima"),
        F.count_if((F.col("v") == F.col("lo")) & (F.col("hi") > F.col("lo"))).alias("n_local_minima"),
    )
    moran = F.when((F.col("zz") > 0) & (F.col("pairs") > 0), F.col("cells") / F.col("pairs") * (F.col("cross_right") + F.col("cross_down")) / F.col("zz"))
    return got.select(
        "feature", F.round("g", 4).alias("gradient_mean"), F.round("gm", 4).alias("gradient_max"), F.round(F.when(F.col("sd") > 0, F.col("g") / F.col("sd")), 4).alias("roughness"), F.round(moran, 4).alias("morans_i"), "n_local_maxima", "n_local_minima"
    )


def spatial_score(stats: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Mean of organisation, smoothness and, given boundary ratios, region coherence."""
    one = stats.agg(F.avg("morans_i").alias("moran"), F.percentile("roughness", 0.5).alias("rough"))
    parts = [(F.col("moran") + 1) / 2, 1 / (1 + F.col("rough"))]
    if boundary is not None:
        one = one.join(F.broadcast(boundary.agg(F.avg("boundary_ratio").alias("edge"))))  # one row
        parts.append(1 - F.col("edge"))
    known = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return one.select(F.round(known, 4).alias("spatial_quality_score"))


def boundary_ratio(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of adjacent active pairs (nid, category) whose categories differ."""
    a, b = cells.alias("a"), cells.alias("b")
    e = edges.where("a < b").alias("e").join(a, F.col("e.a") == F.col("a.nid")).join(b, F.col("e.b") == F.col("b.nid"))
    return e.agg(F.round(F.avg((F.col("a.category") != F.col("b.category")).cast("double")), 6).alias("boundary_ratio"), F.count(F.lit(1)).alias("pairs"))


def regions(cells: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Connected regions of equal category on the grid, the *top* largest: size and centroid."""
    a, b = cells.alias("a"), cells.alias("b")
    same = edges.alias("e").join(a, F.col("e.a") == F.col("a.nid")).join(b, F.col("e.b") == F.col("b.nid")).where("a.category = b.category")
    joined: dict[int, int] = {r.nid: r.nid for r in cells.select("nid").collect()}  # neurons, not rows

    def root(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    for r in same.select(F.col("e.a").alias("a"), F.col("e.b").alias("b")).collect():
        x, y = sorted((root(r.a), root(r.b)))
        joined[y] = x
    labels = cells.sparkSession.createDataFrame([(k, root(k)) for k in joined], "nid int, region int")
    g = cells.join(labels, "nid").groupBy("region", "category").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("i"), 4).alias("centre_i"), F.round(F.avg("j"), 4).alias("centre_j"))
    return g.orderBy(F.desc("size"), "region").limit(top)


def stretched_edges(codebook: DataFrame, edges: DataFrame, share: float = 0.85) -> DataFrame:
    """Grid edges with their weight distance; the longest are flagged."""
    a, b = codebook.alias("a"), codebook.alias("b")
    e = edges.where("a < b").alias("e").join(a, F.col("e.a") == F.col("a.nid")).join(b, F.col("e.b") == F.col("b.nid"))
    e = e.select("e.a", "e.b", F.round(euclid(F.col("a.w"), F.col("b.w")), 6).alias("length"))
    limit = e.agg(F.percentile("length", share).alias("_limit"))
    return e.join(F.broadcast(limit)).select("a", "b", "length", (F.col("length") > F.col("_limit")).alias("stretched"))  # one row
