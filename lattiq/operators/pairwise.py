"""Measures over all pairs of a bounded sample, in blocks.

The sample is gathered once, its size is checked, and it travels to the tasks as one matrix.
A task computes a block of rows against the whole matrix and sends one row for each of
its own, so no pair ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bound on rows x components of a sample that is sent to all tasks.
MAX_SAMPLE = 4_000_000
#: Rows of a block.
BLOCK = 64


def gather(points: DataFrame, id_col: str, vector: str, *others: str) -> dict[str, np.ndarray]:
    """id, x (rows x components) and the other columns as arrays, in order of the id."""
    got = points.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"), *others).orderBy("id")
    size = got.agg(F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_SAMPLE:
        raise ValueError(f"pair measures take a sample of at most {MAX_SAMPLE} numbers")
    rows = got.toArrow()
    out = {c: np.array(rows[c].to_pylist(), object) for c in ("id", *others)}
    return out | {"x": np.array(rows["x"].to_pylist(), float).reshape(rows.num_rows, -1)}


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by summing the components in order, which keeps equal rows at exactly 0."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        total += gap * gap
    return np.sqrt(total)


def blocks(spark: SparkSession, sample: dict[str, np.ndarray], fn: Callable[[dict, slice], dict[str, list]], schema: str) -> DataFrame:
    """Apply *fn*(sample, rows) to each block of rows; it returns columns of *schema*."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n = len(sample["id"])
    shared = spark.sparkContext.broadcast(sample)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                out = fn(shared.value, slice(start, start + BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return spark.range(0, max(n, 1), BLOCK).mapInArrow(run, schema)


def silhouette_rows(points: DataFrame, id_col: str, vector: str, cluster: str) -> DataFrame:
    """(cluster, s) for each row of the sample; a row alone in its cluster, or without a cluster, has 0."""
    sample = gather(points, id_col, vector, cluster)
    named = [c for c in dict.fromkeys(sample[cluster].tolist()) if c is not None]
    member = np.array([[float(c == k) for k in named] for c in sample[cluster].tolist()]).reshape(len(sample["id"]), len(named))

    def fn(s: dict, rows: slice) -> dict[str, list]:
        other = s["id"][rows][:, None] != s["id"][None, :]
        count = other.astype(float) @ member
        mean = np.divide((distances(s["x"][rows], s["x"]) * other) @ member, count, out=np.full(count.shape, np.inf), where=count > 0)
        own = member[rows] > 0
        a, b = np.where(own, mean, np.inf).min(1, initial=np.inf), np.where(own, np.inf, mean).min(1, initial=np.inf)
        fine = np.isfinite(a) & np.isfinite(b) & own.any(1)
        top = np.maximum(a, b)
        value = np.divide(b - a, top, out=np.zeros(len(a)), where=fine & (top > 0))
        return {"cluster": s[cluster][rows].tolist(), "s": value.tolist()}

    kind = points.schema[cluster].dataType.simpleString()
    return blocks(points.sparkSession, sample, fn, f"cluster {kind}, s double")


def neighbour_losses(points: DataFrame, id_col: str, vector: str, i: str, j: str, k: int) -> DataFrame:
    """(gained, lost) for each row: ranks beyond *k* of its map neighbours in the data, and the other way round."""
    sample = gather(points, id_col, vector, i, j)
    sample["xy"] = np.stack([sample[i].astype(float), sample[j].astype(float)], axis=1)

    def ranks(d: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Ranks from 1 in ascending order, ties by id (the columns are in order of the id); the own row comes last."""
        order = np.argsort(np.where(own, np.inf, np.round(d, 9)), axis=1, kind="stable")
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.arange(1, d.shape[1] + 1)[None, :], 1)
        return out

    def fn(s: dict, rows: slice) -> dict[str, list]:
        own = s["id"][rows][:, None] == s["id"][None, :]
        rx, rg = ranks(distances(s["x"][rows], s["x"]), own), ranks(distances(s["xy"][rows], s["xy"]), own)
        gained = np.where((rg <= k) & (rx > k) & ~own, rx - k, 0).sum(1)
        lost = np.where((rx <= k) & (rg > k) & ~own, rg - k, 0).sum(1)
        return {"gained": gained.tolist(), "lost": lost.tolist()}

    return blocks(points.sparkSession, sample, fn, "gained long, lost long")
