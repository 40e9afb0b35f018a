"""Work that must not be done several times over, or in one task."""

import itertools
import random
import statistics

import pandas as pd
from pyspark.sql import functions as F

from lattiq.operators import many, outliers, verify
from lattiq.operators.grid import Grid
from lattiq.streaming import controller


def test_high_qe_computes_errors_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(6000).select("id", (F.col("id") % 977 / 100).alias("qe")).mapInPandas(count, "id long, qe double")
    found = outliers.high_qe(rows.withColumn("qe_dims", F.create_map(F.lit("x"), F.col("qe"))), "id", None, 1.5)
    errors = [k % 977 / 100 for k in range(6000)]
    assert found.count() == sum(e > 1.5 * statistics.median(errors) for e in errors)
    assert seen.value <= 2 * 6000


def test_visits_of_one_file_are_counted_by_several_tasks(spark):
    for reshuffle in (True, False):
        c = many.Config("r", Grid(2, 2, "square"), iterations=9, percent=35, num_batches=3, reshuffle=reshuffle)
        got = many.visits(spark.range(0, 400, 1, 1), "id", c)
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        each = sum((many.chosen(F.col("id"), c, F.lit(t)).cast("int") for t in range(9)), F.lit(0))
        assert got.join(spark.range(400).select("id", each.alias("want")), "id").where("visits <> want").isEmpty()


class Store:
    def __init__(self):
        self.value, self.rows = None, []

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def get(self):
        if self.value is None:
            raise AssertionError("waiting rows are not read to find the first of them")
        return self.value


class Handle(Store):
    timers = ()

    def getValueState(self, *_):  # noqa: N802
        return Store()

    def getListState(self, *_):  # noqa: N802
        return Store()

    def listTimers(self):  # noqa: N802
        return iter([(t,) for t in self.timers])

    def deleteTimer(self, _):  # noqa: N802
        self.timers = ()

    def registerTimer(self, at):  # noqa: N802
        self.timers = (at,)


def test_waiting_rows_are_not_read_when_more_arrive():
    c, h = controller.Controller(controller.Rule(3, 1000)), Handle()
    c.init(h)
    for times in ([5_000_000, 7_000_000], [6_000_000], [4_000_000, 9_000_000]):
        list(c.handleInputRows((1,), iter([pd.DataFrame({"at": times, "id": range(len(times)), "value": 1.0})]), None))
        assert h.timers == (min(5000, times[0] // 1000) + 1,)
    assert len(c.waiting.rows) == 5


def _crossings(points):
    """All pairs, one at a time, by the query's own test."""
    found = pairs = 0
    segments = [(k, a, b) for k, (a, b) in enumerate(itertools.pairwise(points)) if b[0] is not None]

    def side(s, e, t):
        v = (e[0] - s[0]) * (t[1] - s[1]) - (e[1] - s[1]) * (t[0] - s[0])
        return (v > 0) - (v < 0)

    for (i, a, b), (j, c, d) in itertools.combinations(segments, 2):
        if j >= i + 2:
            pairs += 1
            if not any(v is None for p in (a, b, c, d) for v in p):
                found += side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
    return found, pairs


def test_chain_crossings_of_many_blocks(spark):
    rng = random.Random(4)
    points = [(rng.randint(0, 9) / 10 if rng.random() > 0.1 else None, float(rng.randint(0, 6)) if rng.random() > 0.1 else None) for _ in range(90)]
    schema = "id long, x double, y double"
    for n in (0, 1, 2, 3, 7, 8, 9, 14, 90):
        df = spark.createDataFrame([(3 * i, x, y) for i, (x, y) in enumerate(points[:n])], schema)
        for block in (7, 8192):
            assert tuple(verify.chain_crossings(df, "id", "x", "y", block).first()) == _crossings(points[:n]), (n, block)


def test_chain_is_not_one_task(spark):
    rows = spark.range(4000).select("id", F.rand(1).alias("x"), (F.col("id") * 37 % 101).cast("double").alias("y"))
    total = verify.chain_crossings(rows, "id", "x", "y")
    assert "NestedLoop" not in (plan := total._jdf.queryExecution().toString()) and "Cartesian" not in plan
    assert total.first()["pairs"] == 3998 * 3997 // 2
