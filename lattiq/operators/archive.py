"""An archive of non-dominated members that is kept across generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattiq.operators.pareto import first_front
from lattiq.session import materialize


def advance(archive: DataFrame | None, newcomers: DataFrame, generation: int, uid: str, objs: list[str], cv: str) -> DataFrame:
    """The archive after a generation: (uid, objectives, cv, entered, retired).

    Newcomers are thinned to their own front first and only these meet the active members. A
    member that a newcomer dominates is retired with the generation and kept on record;
    uids that the archive has seen are no newcomers.
    """
    cols = [uid, *objs, cv]
    new = newcomers.select(*cols).dropDuplicates([uid])
    if archive is not None:
        new = new.join(archive.select(uid), uid, "left_anti")
    new = first_front(new, uid, objs, cv).select(*cols, F.lit(generation).alias("entered"), F.lit(None).cast("int").alias("retired"))
    new = materialize(new, "archive-new")
    if archive is None:
        return new
    active = archive.where("retired IS NULL")
    stays = first_front(active.unionByName(new).select(*cols), uid, objs, cv).select(uid, F.lit(True).alias("stays"))
    joined = archive.unionByName(new).join(stays, uid, "left").where((F.col("entered") < generation) | F.col("stays"))
    falls = F.col("retired").isNull() & F.col("stays").isNull()
    return materialize(joined.withColumn("retired", F.when(falls, F.lit(generation)).otherwise(F.col("retired"))).drop("stays"), "archive")


def evolve_archive(rows: DataFrame, generation: str, uid: str, objs: list[str], cv: str) -> DataFrame:
    """Advance an archive through the generations of *rows* in ascending order; without rows it is empty."""
    steps = [r[0] for r in rows.select(generation).where(F.col(generation).isNotNull()).distinct().orderBy(generation).collect()]  # one number a generation
    archive: DataFrame | None = None
    for g in steps:
        archive = advance(archive, rows.where(F.col(generation) == g), int(g), uid, objs, cv)
    empty = rows.select(uid, *objs, cv, F.lit(0).alias("entered"), F.lit(None).cast("int").alias("retired")).where(F.lit(False))
    return empty if archive is None else archive
