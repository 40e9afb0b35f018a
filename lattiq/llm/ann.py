"""Approximate nearest neighbours over learned partitions.

Fitting takes a bounded sample of the vectors, builds its exact neighbour graph, cuts the
graph into balanced partitions, and trains a small softmax classifier that tells a
vector's partition. Every row is indexed under its most probable partition; a query
visits its several most probable partitions, where all rows are reranked by exact
distance. The number of partitions grows with the table, and the number visited is
chosen on held-out sample rows so that recall there reaches ``target_recall``.

Partitions hold any number of rows: a partition is split into row blocks and query
blocks of bounded size by a hash of the id, each pair of blocks gives its own nearest
rows, and one small aggregate per query picks the best of those, so a vector that
a third of all rows share makes more blocks and no larger ones.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do vectors of another dimension than the most frequent one; ties go to the
smaller id; with fewer candidates than ``k`` all are returned; a query whose visited
partitions hold too few rows visits all; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lattiq.llm.arrow import map_batches
from lattiq.session import materialize


@dataclass(frozen=True)
class Router:
    mean: np.ndarray
    scale: float
    weight: np.ndarray  # (dim, parts)
    bias: np.ndarray
    probes: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def top(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.log_odds(x), axis=1, kind="stable")[:, :n]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = squared(x[a : a + 512], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 12) -> np.ndarray:
    """Cut the neighbour graph into *parts* of nearly equal size.

    Starts from regions grown around spread-out seeds and then moves nodes, in sweeps, to
    the part that holds most of their neighbours (both directions) while it has room.
    """
    n = len(x)
    cap = int(np.ceil(1.05 * n / parts))
    seeds = [int(rng.integers(n))]
    gap = squared(x[seeds], x)[0]
    for _ in range(parts - 1):
        seeds.append(int(rng.choice(n, p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(n)))
        gap = np.minimum(gap, squared(x[seeds[-1:]], x)[0])
    centres = x[seeds]
    for _ in range(4):
        near = squared(x, centres).argmin(1)
        centres = np.stack([x[near == p].mean(0) if (near == p).any() else centres[p] for p in range(parts)])
    order, d = np.arange(n), squared(x, centres)
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    for i in order[np.argsort(d.min(1), kind="stable")]:
        p = next(p for p in np.argsort(d[i], kind="stable") if size[p] < cap)
        part[i], size[p] = p, size[p] + 1
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    for _ in range(sweeps):
        moves = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[np.concatenate([graph[i], back[i]]).astype(np.int64)], minlength=parts)
            p = int(np.where(size < cap, votes, -1).argmax())
            if votes[p] > votes[part[i]]:
                size[part[i]] -= 1
                size[p] += 1
                part[i] = p
                moves += 1
        if moves < n // 500:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, epochs: int = 40) -> Router:
    """Softmax regression by mini-batch Adam."""
    mean, scale = x.mean(0), float(x.std()) or 1.0
    z = (x - mean) / scale
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m1, m2, step = np.zeros((x.shape[1] + 1, parts)), np.zeros((x.shape[1] + 1, parts)), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            s = z[rows] @ w + b
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            s[np.arange(len(rows)), part[rows]] -= 1.0
            g = np.vstack([z[rows].T @ s + 1e-4 * w, s.sum(0)]) / len(rows)
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            d = 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
    return Router(mean, scale, w, b, parts)


def fit(sample: np.ndarray, parts: int, k: int = 10, target_recall: float = 0.97, seed: int = 7) -> Router:
    """Partition, train and calibrate on *sample*; a fifth of it is held out as queries."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))]
    n_queries = len(x) // 5
    queries, base = x[:n_queries], x[n_queries:]
    parts = max(1, min(parts, len(base) // 8))
    if parts == 1 or n_queries == 0:
        return Router(np.zeros(x.shape[1]), 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(base, min(10, len(base) - 1))
    router = train_router(base, balanced_partition(base, graph, parts, rng), parts, rng)
    home = router.top(base, 1)[:, 0]
    near = np.argsort(squared(queries, base), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-router.log_odds(queries), axis=1, kind="stable"), axis=1)
    seen = place[np.arange(n_queries)[:, None], home[near]]  # probes needed to meet each true neighbour
    recall = [(seen < p).mean() for p in range(1, parts + 1)]
    probes = next((p for p, r in enumerate(recall, 1) if r >= target_recall), parts)
    return Router(router.mean, router.scale, router.weight, router.bias, probes)


def usable(vector: Column) -> Column:
    """Not null, not zero, every component there and finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _block_top(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(rows):
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64)
            for a in range(0, len(queries), 256):
                part = queries.iloc[a : a + 256]
                qx = np.stack(part["vector"].to_numpy()).astype(np.float64)
                d = squared(qx, x)
                for i, q in enumerate(part["query_id"].to_numpy()):
                    free = ids != q
                    if not free.any():
                        continue
                    kth = np.partition(np.where(free, d[i], np.inf), min(k, free.sum()) - 1)[min(k, free.sum()) - 1]
                    # the quick distances choose rows within rounding; the exact ones rank them
                    got = np.flatnonzero(free & (d[i] <= kth + 1e-9 * (1.0 + kth + (qx[i] ** 2).sum())))
                    score = np.sqrt(((x[got] - qx[i]) ** 2).sum(1))
                    best = np.lexsort((ids[got], score))[:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[got][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 6000,
    rows_per_part: int = 1000,
    max_parts: int = 256,
    block_rows: int = 8000,
    block_queries: int = 2000,
    target_recall: float = 0.97,
) -> DataFrame:
    """Per query: its *k* nearest found, as query_id, rank, vec_id, score.

    *sample_rows* bounds the fit; *block_rows* and *block_queries* bound what a task holds.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query")
    )
    dims = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = dims[0]
    good = good.where(F.size("vector") == dim)
    share = min(1.0, sample_rows / n)
    chosen = good.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector").orderBy(F.xxhash64("vector")).limit(2 * sample_rows)
    sample = np.array([r[0] for r in chosen.collect()], np.float64).reshape(-1, dim)
    router = fit(sample, int(min(max_parts, max(1, n // rows_per_part))), k, target_recall)
    shared = spark.sparkContext.broadcast(router)

    def assign(rows: dict) -> dict:
        x = np.array(rows["vector"], np.float64)
        r = shared.value
        top = r.top(x, r.probes).tolist()
        return {**rows, "home": [t[0] for t in top], "visits": [t if q else None for t, q in zip(top, rows["is_query"], strict=True)]}

    schema = "vec_id long, vector array<double>, is_query boolean, home int, visits array<int>"
    indexed = materialize(map_batches(good, assign, schema), "ann-index")
    parts = len(router.bias)
    sizes = {r[0]: r[1] for r in indexed.groupBy("home").count().collect()}
    asked = indexed.where("is_query")
    # all partitions for queries whose visited ones may hold fewer than k others
    held = F.create_map(*[F.lit(v) for p in range(parts) for v in (p, sizes.get(p, 0))])
    room = F.aggregate(F.transform("visits", lambda p: held[p].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    everywhere = F.array(*[F.lit(p) for p in range(parts)])
    visits = asked.select(F.col("vec_id").alias("query_id"), "vector", F.explode(F.when(room > k, F.col("visits")).otherwise(everywhere)).alias("part"))
    asks = {r[0]: r[1] for r in visits.groupBy("part").count().collect()}

    def blocks(counts: dict, each: int) -> Column:
        return F.create_map(*[F.lit(v) for p in range(parts) for v in (p, max(1, -(-counts.get(p, 0) // each)))])

    row_blocks, ask_blocks = blocks(sizes, block_rows), blocks(asks, block_queries)
    rows = indexed.select("vec_id", "vector", F.col("home").alias("part"), F.pmod(F.xxhash64("vec_id"), row_blocks[F.col("home")]).cast("int").alias("rb")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), ask_blocks[F.col("part")] - 1))
    )
    asked_in = visits.withColumn("qb", F.pmod(F.xxhash64("query_id"), ask_blocks[F.col("part")]).cast("int")).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), row_blocks[F.col("part")] - 1))
    )
    key = ["part", "rb", "qb"]
    found = asked_in.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(_block_top(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
