"""Training of many maps in one scan, on sampled sections of a table of any size.

An iteration trains each configuration on its own share of the rows. Which rows these are is a
condition on a row's id: a permutation of the rows is the order of their hashes, and an iteration
takes the next part of it, going on with a new permutation at its end (*reshuffle*), or draws by a
hash of its own. So rows are chosen by a filter, wherever they are, and visit counts are
an expression. One iteration of all configurations is one scan and one aggregate keyed by
(configuration, neuron); its sums come to the driver, the rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lattiq.operators.grid import Grid
from lattiq.operators.som import MAX_CODEBOOK, Codebook, neighbourhood
from lattiq.session import materialize, shuffle_partitions


@dataclass(frozen=True)
class Config:
    uid: str
    grid: Grid
    seed: int = 42
    iterations: int = 15
    #: Whole per cent of the rows that an iteration takes.
    percent: int = 10
    num_batches: int = 1
    reshuffle: bool = True
    start_rate: float = 0.5
    end_rate: float = 0.02
    radius_ratio: float = 0.5

    def share(self, t: int) -> float:
        return t / max(1, self.iterations - 1)

    def rate(self, t: int) -> float:
        return self.start_rate * (1 - self.share(t)) + self.end_rate * self.share(t)

    def radius(self, t: int) -> float:
        return max(0.3, max(self.grid.m, self.grid.n) * self.radius_ratio * (1 - self.share(t)))


def _hash(parts: list) -> Column:
    """32 bits of the MD5 of the parts joined by colons, as a long."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _section(row_id: Column, config: Config) -> Column:
    return F.pmod(_hash([row_id, config.seed]), F.lit(config.num_batches))


def _in_part(here: Column, after: Column, begin: Column, percent: int) -> Column:
    """Whether the part that begins at *begin* per cent holds a row, by its places in that permutation and the next one."""
    unit, low = F.lit(1 << 32), F.pmod(begin, F.lit(100))
    return ((here >= low * unit) & (here < (low + percent) * unit)) | (after < (low + percent - 100) * unit)


def chosen(row_id: Column, config: Config, t: Column) -> Column:
    """Whether iteration *t* trains on a row; each section has permutations of its own."""
    section = _section(row_id, config)
    if not config.reshuffle:
        return _hash([row_id, config.seed, section, "draw", t]) * 100 < F.lit(config.percent) * F.lit(1 << 32)
    begin = t * config.percent
    turn = F.floor(begin / 100)
    here, after = (_hash([row_id, config.seed, section, x]) * 100 for x in (turn, turn + 1))
    return _in_part(here, after, begin, config.percent)


def visits(df: DataFrame, id_col: str, config: Config) -> DataFrame:
    """(id, visits): how many iterations train on each row.

    The ids are dealt evenly, as a small file would be one task's, and a row's place in a permutation is hashed once.
    """
    rows = df.select(id_col).repartition(shuffle_partitions(df.sparkSession)).withColumn("_section", _section(F.col(id_col), config))
    steps, percent = F.sequence(F.lit(0), F.lit(config.iterations - 1)), config.percent

    def place(*parts) -> Column:
        return _hash([F.col(id_col), config.seed, F.col("_section"), *parts]) * 100

    if config.reshuffle:
        last = (config.iterations - 1) * percent // 100 + 1
        rows = rows.withColumn("_places", F.transform(F.sequence(F.lit(0), F.lit(last)), lambda turn: place(turn)))

        def hit(t: Column) -> Column:
            turn = F.floor(t * percent / 100).cast("int")
            return _in_part(F.col("_places")[turn], F.col("_places")[turn + 1], t * percent, percent)
    else:

        def hit(t: Column) -> Column:
            return place("draw", t) < F.lit(percent) * F.lit(1 << 32)

    return rows.select(id_col, F.aggregate(steps, F.lit(0), lambda n, t: n + hit(t).cast("int")).alias("visits"))


def _check(books: list[Codebook]) -> None:
    if sum(b.weights.size for b in books) > MAX_CODEBOOK:
        raise ValueError("the codebooks are too large to be sent to all tasks together")


def _two_nearest(x: np.ndarray, seen: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nearest and the second neuron, and the distance to the nearest; ties take the lower one."""
    d = np.zeros((len(x), len(w)))
    for k in range(x.shape[1]):
        gap = (x[:, k, None] - w[None, :, k]) * seen[:, k, None]
        d += gap * gap
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    return order, np.sqrt(np.take_along_axis(d, order[:, :1], 1)[:, 0])


def _scan(df: DataFrame, books: list[Codebook], conditions: list[Column], schema: str, fold) -> DataFrame:
    """Apply *fold*(no, book, rows, mask) in each task to the rows of every configuration, in chunks; it returns partial rows."""
    _check(books)
    features = list(books[0].features)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]).alias("chosen"))
    rows = rows.where(F.exists("chosen", lambda c: c))
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(features))], axis=1)
            picked = np.array(batch.column(len(features)).flatten().to_numpy(zero_copy_only=False), bool).reshape(batch.num_rows, -1)
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            for no, book in enumerate(shared.value):
                own = picked[:, no]
                if own.any():
                    yield pa.RecordBatch.from_pydict(fold(no, book, x[own], seen[own]))

    return rows.mapInArrow(run, schema)


def epoch_sums(df: DataFrame, books: list[Codebook], conditions: list[Column]) -> DataFrame:
    """(config, nid, feature, total, n) over the chosen rows of each configuration."""

    def fold(no: int, book: Codebook, x: np.ndarray, seen: np.ndarray) -> dict:
        near, _ = _two_nearest(x, seen, book.weights)
        total, n = np.zeros(book.weights.shape), np.zeros(book.weights.shape, np.int64)
        np.add.at(total, near[:, 0], x)
        np.add.at(n, near[:, 0], seen)
        nid, feature = np.nonzero(n)
        return {"config": np.full(len(nid), no, np.int32), "nid": nid.astype(np.int32), "feature": feature.astype(np.int32), "total": total[nid, feature], "n": n[nid, feature]}

    parts = _scan(df, books, conditions, "config int, nid int, feature int, total double, n long", fold)
    return parts.groupBy("config", "nid", "feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def epoch(df: DataFrame, books: list[Codebook], conditions: list[Column], radii: list[float], rates: list[float]) -> list[Codebook]:
    """One iteration of all configurations: weights move towards their neighbourhoods' means by the rate."""
    sums = [(np.zeros(b.weights.shape), np.zeros(b.weights.shape)) for b in books]
    for r in epoch_sums(df, books, conditions).collect():  # configurations x neurons x features
        sums[r["config"]][0][r["nid"], r["feature"]] = r["total"]
        sums[r["config"]][1][r["nid"], r["feature"]] = r["n"]
    moved = []
    for b, (total, n), radius, rate in zip(books, sums, radii, rates, strict=True):
        h = neighbourhood(b.grid, radius)
        mass = h @ n
        aim = np.where(mass > 1e-12, (h @ total) / np.where(mass > 1e-12, mass, 1), b.weights)
        moved.append(Codebook(b.grid, b.features, b.weights + rate * (aim - b.weights)))
    return moved


def quality(df: DataFrame, books: list[Codebook]) -> DataFrame:
    """(config, n, mqe, te, dead, d_max) over all rows, in one scan.

    Mean error, share of rows whose two best neurons are no neighbours, share of unused neurons, and the largest
    mean error of a neuron.
    """

    def fold(no: int, book: Codebook, x: np.ndarray, seen: np.ndarray) -> dict:
        near, gap = _two_nearest(x, seen, book.weights)
        step = neighbourhood(book.grid, 1.0)
        apart = step[near[:, 0], near[:, -1]] < np.exp(-0.75) if near.shape[1] > 1 else np.zeros(len(x), bool)
        hits = np.bincount(near[:, 0], minlength=book.grid.size)
        nid = np.flatnonzero(hits)
        sums = [np.bincount(near[:, 0], v, minlength=book.grid.size)[nid] for v in (gap, apart.astype(float))]
        return {"config": np.full(len(nid), no, np.int32), "nid": nid.astype(np.int32), "n": hits[nid].astype(np.int64), "gap": sums[0], "apart": sums[1]}

    parts = _scan(df, books, [F.lit(True)] * len(books), "config int, nid int, n long, gap double, apart double", fold)
    sizes = F.element_at(F.array(*[F.lit(b.grid.size) for b in books]), F.col("config") + 1)
    n = F.sum("n")
    neurons = parts.groupBy("config", "nid").agg(*[F.sum(c).alias(c) for c in ("n", "gap", "apart")])
    whole = neurons.groupBy("config").agg(n.alias("n"), (F.sum("gap") / n).alias("mqe"), (F.sum("apart") / n).alias("te"), F.count(F.lit(1)).alias("used"), F.max(F.col("gap") / F.col("n")).alias("d_max"))
    return whole.select("config", "n", "mqe", "te", (1 - F.col("used") / sizes).alias("dead"), "d_max")


def roughness(book: Codebook) -> float:
    """Largest cell of the rook U-matrix: summed distance of a neuron's weights to those beside it, over 4 less one for each border."""
    m, n = book.grid.m, book.grid.n
    w = book.weights.reshape(m, n, -1)
    down, right = (np.linalg.norm(np.diff(w, axis=k), axis=2) for k in (0, 1))
    total = np.zeros((m, n))
    total[:-1] += down
    total[1:] += down
    total[:, :-1] += right
    total[:, 1:] += right
    i, j = np.indices((m, n))
    borders = (i == 0).astype(int) + (j == 0) + ((i == m - 1) & (m > 1)) + ((j == n - 1) & (n > 1))
    return float((total / (4 - borders)).max())


def train_together(df: DataFrame, id_col: str, features: list[str], configs: list[Config]) -> tuple[list[Codebook], list[dict]]:
    """Train all configurations side by side; their codebooks, and per configuration first_mqe, mqe, te, dead over all rows.

    The rows are dealt evenly and written once, as each iteration scans them and a small file would be one task's.
    """
    df = materialize(df.select(id_col, *[f for f in features if f != id_col]).repartition(shuffle_partitions(df.sparkSession)), "training-rows")
    books = [Codebook.random(c.grid, features, c.seed) for c in configs]
    first: list[dict] = []
    for t in range(max(c.iterations for c in configs)):
        conditions = [chosen(F.col(id_col), c, F.lit(t)) if t < c.iterations else F.lit(False) for c in configs]
        books = epoch(df, books, conditions, [c.radius(t) for c in configs], [c.rate(t) for c in configs])
        if t == 0:
            first = [r.asDict() for r in quality(df, books).collect()]
    last = {r["config"]: r.asDict() for r in quality(df, books).collect()}
    begin = {r["config"]: r["mqe"] for r in first}
    return books, [last[k] | {"uid": c.uid, "first_mqe": begin[k]} for k, c in enumerate(configs) if k in last]
