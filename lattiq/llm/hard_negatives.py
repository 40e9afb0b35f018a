"""Hard negatives by exact integer scores: matrix products in residue numbers.

Vectors become integers. A product of two integer matrices is formed modulo several small
primes: residues are balanced around zero and so small that a float32 sum over a vector's
components is an exact integer, so each component product is one ordinary float32 matrix
product. Balanced mixed-radix digits then give the exact signed scores (the Chinese
remainder theorem); as many primes are used as the largest possible score asks for.

Anchors travel in pieces of at most ``piece`` vectors, so what is broadcast is bounded, and every
task scans its rows against a piece in blocks. Two scans are made: the first keeps, in each
task, every anchor's best rows of its own label; the windows of the positives that come out
bound the second, which keeps the best rows of other labels in each window. A task
sends a few rows an anchor, whatever it has read, and Spark picks the best of them.

Defined results: rows with a null id or label, a null or empty vector, or a null or non-finite
component take no part, nor do vectors of another dimension than the most frequent one
(ties: the smaller), nor vectors whose integers have a squared length over 2**61, as their scores
need not fit a long; of rows that repeat an id, the one with the smallest label and then vector
counts; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq.session import materialize

#: Rows and anchors that are multiplied at once, and components that one product sums.
_ROWS, _ANCHORS, _DEPTH = 2048, 512, 1024
_LEAST = np.iinfo(np.int64).min


def primes_below(limit: int) -> Iterator[int]:
    for n in range(limit - 1 - limit % 2, 2, -2):
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            yield n


@dataclass(frozen=True)
class Residues:
    """Primes for vectors of *dim* components with scores of at most *bound*."""

    primes: tuple[int, ...]

    @classmethod
    def of(cls, dim: int, bound: int) -> Residues:
        # a float32 holds integers up to 2**24; half of that leaves room for the reduction
        limit = 2 * int((2**23 / max(1, min(dim, _DEPTH))) ** 0.5) + 1
        chosen, product = [], 1
        for p in primes_below(min(limit, 2047)):
            if product > 8 * (bound + 1):
                break
            chosen.append(p)
            product *= p
        return cls(tuple(chosen))

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """Balanced residues of integers, one float32 matrix a prime."""
        return [((x + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def product(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Exact int64 scores of all rows of a and b."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.primes):
            r = _balanced(a[k][:, :_DEPTH] @ b[k][:, :_DEPTH].T, p)
            for s in range(_DEPTH, a[k].shape[1], _DEPTH):
                r = _balanced(r + _balanced(a[k][:, s : s + _DEPTH] @ b[k][:, s : s + _DEPTH].T, p), p)
            for q, d in zip(self.primes[:k], digits, strict=True):
                r = _balanced((r - d) * np.float32(pow(q, -1, p)), p)
            digits.append(r)
        score = digits[-1].astype(np.int64)
        for p, d in zip(self.primes[-2::-1], digits[-2::-1], strict=True):
            score = score * p + d.astype(np.int64)
        return score


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    return x - np.float32(p) * np.rint(x * np.float32(1.0 / p))


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score in a positive's window: 50 p <= 100 n <= 95 p, without a product that overflows."""
    return -((-positive) // 2), positive - -(-positive // 20)


class Best:
    """The best *k* (score, id) of each of a number of lists, higher scores first, then smaller ids."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.at = np.zeros(0, np.int64)
        self.score, self.id = self.at.copy(), self.at.copy()
        self.floor = np.full(lists, _LEAST)
        self.floor_id = np.full(lists, np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (score > self.floor[at]) | ((score == self.floor[at]) & (ids < self.floor_id[at]))
        if not keep.any():
            return
        at, score, ids = (np.concatenate((old, new[keep])) for old, new in ((self.at, at), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, at))  # ~score falls as score rises, without overflow
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.score, self.id = at[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.floor[at[full]], self.floor_id[at[full]] = score[full], ids[full]


def whole_numbers(rows: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, q): rows that take part, one for each id, with integer components."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
    q = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    wide = good.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), q.alias("d"))
    length = F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x)
    small = wide.where(length <= 2.0**61).select("vec_id", "label", F.transform("d", lambda x: x.cast("long")).alias("q"))
    one = small.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("vec_id", "r.label", "r.q")


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _scan(rows: DataFrame, shared, dim: int, k: int) -> DataFrame:
    """(list, score, vec_id): in each task the best *k* rows of every list of a piece of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value
        numbers, ids, labels = piece["residues"], piece["ids"], piece["labels"]
        sides = [numbers.split(piece["q"][s : s + _ANCHORS]) for s in range(0, len(ids), _ANCHORS)]
        windows = piece.get("windows")
        best = Best(len(ids) * (1 if windows is None else windows[0].shape[1]), k)

        def meet(own: np.ndarray, label: np.ndarray, q: np.ndarray) -> None:
            side = numbers.split(q)
            for no, s in enumerate(range(0, len(ids), _ANCHORS)):
                score = numbers.product(sides[no], side)
                part = slice(s, s + _ANCHORS)
                same = labels[part, None] == label[None, :]
                if windows is None:
                    _keep(best, score, same & (ids[part, None] != own[None, :]), s, 1, 0, own)
                else:
                    for w in range(windows[0].shape[1]):
                        low, high = windows[0][part, w, None], windows[1][part, w, None]
                        _keep(best, score, ~same & (score >= low) & (score <= high), s, windows[0].shape[1], w, own)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= _ROWS:
                meet(*_columns(held, dim))
                held, size = [], 0
        if size:
            meet(*_columns(held, dim))
        yield pa.RecordBatch.from_arrays([pa.array(best.at), pa.array(best.score), pa.array(best.id)], names=["list", "score", "vec_id"])

    return rows.mapInArrow(run, "list long, score long, vec_id long")


def _columns(held: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols = [[b.column(k) for b in held] for k in range(3)]
    return np.concatenate([c.to_numpy() for c in cols[0]]), np.concatenate([c.to_numpy() for c in cols[1]]), np.concatenate([_matrix(c, dim) for c in cols[2]])


def _keep(best: Best, score: np.ndarray, fit: np.ndarray, first: int, stride: int, place: int, ids: np.ndarray) -> None:
    """Offer the fitting scores of a block to the lists (first + row) * stride + place."""
    lists = (first + np.arange(len(score))) * stride + place
    fit &= score >= best.floor[lists][:, None]
    if score.shape[1] > best.k and np.count_nonzero(fit) > 16 * best.k * len(score):
        top = np.partition(np.where(fit, score, _LEAST), score.shape[1] - best.k, axis=1)
        fit &= score >= top[:, score.shape[1] - best.k, None]
    row, col = np.nonzero(fit)
    best.add(lists[row], score[row, col], ids[col])


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 3,
    scale: int = 256,
    piece: int = 8192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    *is_anchor* is a condition on ``vec_id``. *label* may be any expression; the column
    ``label`` by default.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(whole_numbers(vectors, F.col("label") if label is None else label, id_col, vector_col, scale), "negatives-rows")
    length = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dims = rows.groupBy(F.size("q").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("most")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim, _, most = dims[0]
    rows = rows.where(F.size("q") == dim).select("vec_id", "label", "q")
    residues = Residues.of(dim, int(most * 1.001) + 1)  # no score exceeds the largest squared length
    anchors = rows.where(is_anchor)
    pieces = max(1, -(-anchors.count() // (piece // 2)))  # half full on average, so that none is far above
    anchors = materialize(anchors.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).cast("int")), "negatives-anchors")
    found: DataFrame | None = None
    for no in range(pieces):
        part = anchors.where(F.col("piece") == no).orderBy("vec_id").toArrow()
        if not part.num_rows:
            continue
        data = {"residues": residues, "ids": part["vec_id"].to_numpy(), "labels": part["label"].to_numpy(), "q": _matrix(part["q"].combine_chunks(), dim)}
        own = _best_of(_scan(rows, spark.sparkContext.broadcast(data), dim, n_positives), n_positives)
        own = own.toArrow().sort_by([("list", "ascending"), ("rank", "ascending")])  # a few rows for each anchor of the piece
        at, rank, score, ids = (own[c].to_numpy() for c in ("list", "rank", "score", "vec_id"))
        places = (len(data["ids"]), n_positives)
        low, high, positive = np.zeros(places, np.int64), np.full(places, -1), np.full(places, -1)
        low[at, rank - 1], high[at, rank - 1] = window(score)
        positive[at, rank - 1] = np.arange(len(at))
        shared = spark.sparkContext.broadcast(data | {"windows": (low, high)})
        other = _best_of(_scan(rows, shared, dim, n_negatives), n_negatives)
        names = pa.table({"list": at * n_positives + rank - 1, "anchor_id": data["ids"][at], "positive_id": ids, "positive_score": score})
        named = other.select("list", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(spark.createDataFrame(names), "list")
        got = materialize(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        found = got if found is None else found.unionByName(got)
    return found if found is not None else spark.createDataFrame([], schema)


def _best_of(kept: DataFrame, k: int) -> DataFrame:
    """(list, rank, score, vec_id): the best of what the tasks have kept."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("list", "rank", "score", "vec_id")
