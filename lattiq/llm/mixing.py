"""Mixing sources to target weights by entropy balancing.

Rates of documents are as near as they can be, in relative entropy, to one copy each while every
source's words add up to its target and no document is taken more than ``most`` times. The
solution is an exponential tilt, rate = min(most, exp(lambda * size / mean size)), with one
multiplier a source. The convex dual is solved by Newton steps, all sources at once: a
step is one aggregate over the distinct (source, size) pairs, which stand for all
documents, and a bracket around each multiplier takes over where a step leaves it.

Rates become copies by one threshold a source: a document gets the whole part of its rate, and
one copy more if its hash, less the fraction, is under the threshold. The threshold is
found by radix selection over words, so that the words taken come up to the target within
one document; what is left is filled in the same way with documents that still fit.

Rates are fixed-point integers and all sums over documents are integers, so reruns agree whatever
the order of rows. Nothing is sorted or gathered by source: a hot source is partial sums.
Only one row of totals at a time comes to the driver.

Defined results: null text has no words; rows without words are kept and taken 0 times; the
null source is a source of its own, the last; repeated rows are rows of their own; an
empty table gives an empty result; a table without words has targets of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq.session import materialize

#: Fixed-point unit of a rate.
UNIT = 1 << 20
#: Bits of a document's place in the rounding order, and bits that one selection round looks at.
_BITS, _ROUND = 60, 12


def word_count(text: Column) -> Column:
    """Number of runs without the contract's white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(names: DataFrame, col: str) -> DataFrame:
    """*names* with ``no``, its place from 0 in ascending order of *col*, nulls last; ranges are sorted apart."""
    ordered = materialize(names.repartitionByRange(F.asc_nulls_last(col)).select("*", F.spark_partition_id().alias("part")), "mix-names")
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last(col))) - 1
    return ordered.withColumn("local", local).join(before.select("part", "before"), "part").select(*names.columns, (F.col("before") + F.col("local")).alias("no"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3) -> DataFrame:
    """(source, source_no, source_size, weight, target) of (source, size): shares of all sizes by weight, at most *most* times a source's size.

    What is over the limit is dealt again by weight among the others until none is above it.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    named = materialize(_numbered(sums, "source").withColumn("weight", share), "mix-sources")
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    limit = F.col("source_size") * most
    # full sources are those whose limit over weight is under the level; more fill up until none does
    level, full = 0.0, -1
    while True:
        over = limit < F.col("weight") * level
        row = named.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row["n"] == full or row["open"] is None:
            break
        full, level = row["n"], (total - row["held"]) / row["open"]
    return named.select("source", F.col("no").alias("source_no"), "source_size", "weight", F.least(limit.cast("double"), F.col("weight") * level).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    """Fixed-point rate of a document."""
    tilt = F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), multiplier * size / mean)))
    return F.when(size > 0, F.round(F.least(F.lit(float(most)), tilt) * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))


def solve(sizes: DataFrame, goals: DataFrame, most: int = 3, close: float = 2e-5, rounds: int = 200) -> DataFrame:
    """*goals* with ``mean`` (size) and ``multiplier``: the dual's solution by safeguarded Newton steps.

    *sizes* is (source_no, size). The dual's gradient of a source is the words its rates take,
    less its target; it rises with the multiplier.
    """
    pairs = materialize(sizes.where("size > 0").groupBy("source_no", "size").agg(F.count(F.lit(1)).alias("n")), "mix-pairs")
    means = pairs.groupBy("source_no").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    start = goals.join(means, "source_no", "left").select(goals["*"], F.coalesce("mean", F.lit(1.0)).alias("mean"), "least")
    # beyond 60 means in the smallest document every rate has reached its end
    far = 60.0 * F.col("mean") / F.coalesce("least", F.lit(1))
    state = materialize(start.select(*goals.columns, "mean", (-far).alias("low"), far.alias("high"), F.lit(0.0).alias("multiplier"), F.lit(False).alias("done")), "mix-state")
    for _ in range(rounds):
        rated = pairs.join(state.where("NOT done").select("source_no", "mean", "multiplier"), "source_no")
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
        inner = F.when(rate < most * UNIT, rate).otherwise(0)
        sums = rated.groupBy("source_no").agg(
            F.sum((F.col("size") * F.col("n")).cast("decimal(38,0)") * rate).cast("double").alias("words"),
            F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n") * inner).cast("double").alias("slope"),
        )
        gap = F.col("words") / UNIT - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - gap / (F.col("slope") / UNIT / F.col("mean"))
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        settled = (F.abs(gap) <= close * F.col("target")) | (high - low <= 1e-12 * F.greatest(F.abs(high), F.lit(1e-6))) | gap.isNull()
        step = state.join(sums, "source_no", "left").select(
            *goals.columns,
            "mean",
            F.when(F.col("done"), F.col("low")).otherwise(F.coalesce(low, "low")).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(F.coalesce(high, "high")).alias("high"),
            F.when(F.col("done") | settled, F.col("multiplier")).otherwise(F.when(inside, newton).otherwise((low + high) / 2)).alias("multiplier"),
            (F.col("done") | settled).alias("done"),
        )
        state = materialize(step, "mix-state")
        if state.where("NOT done").isEmpty():
            break
    return state.select(*goals.columns, "mean", "multiplier")


def _threshold(rows: DataFrame, room: DataFrame, by: str) -> DataFrame:
    """(source_no, cut, left) for rows (source_no, place, size) and room (source_no, room).

    The rows with ``place`` under the cut have sizes of at most ``room`` together, and the row at
    the cut would not fit any more. Each round sums sizes by the next digit of the places
    that share the cut's leading digits; these sums are at most 2**12 rows a source.
    """
    state = room.select("source_no", F.lit(0).cast("long").alias("cut"), F.greatest(F.col("room"), F.lit(0).cast("long")).alias("left"), F.lit(True).alias("open"))
    for shift in range(_BITS - _ROUND, -1, -_ROUND):
        state = materialize(state, f"mix-{by}")
        if state.where("open").isEmpty():
            break
        above = shift + _ROUND
        digit = F.shiftright("place", shift) % (1 << _ROUND)
        here = rows.join(state.where("open").select("source_no", "cut"), "source_no").where(F.shiftright("place", above) == F.shiftright("cut", above))
        sums = here.groupBy("source_no", digit.alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        running = F.sum("size").over(Window.partitionBy("source_no").orderBy("digit"))
        fits = sums.withColumn("running", running).join(state.select("source_no", "left"), "source_no")
        taken = fits.groupBy("source_no").agg(
            F.coalesce(F.max(F.when(F.col("running") <= F.col("left"), F.col("running"))), F.lit(0)).alias("taken"),
            F.min(F.when(F.col("running") > F.col("left"), F.struct("digit", "n"))).alias("next"),
        )
        # without a digit that overflows, all these rows fit: the cut is their end
        end = F.shiftleft(F.shiftright("cut", above) + 1, above)
        state = state.join(taken, "source_no", "left").select(
            "source_no",
            F.when(~F.col("open"), F.col("cut")).when(F.col("next").isNull(), end).otherwise(F.col("cut") + F.shiftleft(F.col("next.digit").cast("long"), shift)).alias("cut"),
            (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"),
            (F.col("open") & (F.coalesce("next.n", F.lit(0)) > 1)).alias("open"),  # a single row is the one that does not fit
        )
    return materialize(state.select("source_no", "cut", "left"), f"mix-{by}")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
    tolerance: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, copies, rate.

    *tolerance*: the share of its target that a source may stay away from it before
    documents that still fit are looked for.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    goals = materialize(targets(rows.select("source", "size"), weights, most), "mix-goals")
    same = rows["source"].eqNullSafe(goals["source"])
    placed = rows.join(goals, same).select("doc_id", "row", "source_no", "size")
    solved = solve(placed.select("source_no", "size"), goals, most)
    rated = placed.join(solved.select("source_no", "mean", "multiplier"), "source_no")
    rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
    # the place in the rounding order: hash less fraction, then another hash; only rows alike in id and size are told apart by row
    part = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "size"), F.lit(UNIT)) - F.col("rate") % UNIT + UNIT
    more = F.pmod(F.xxhash64(F.lit("tie"), "doc_id", "size"), F.lit(1 << 19))
    last = F.pmod(F.xxhash64(F.lit("row"), "row"), F.lit(1 << 20))
    place = F.shiftleft(part, 39) + F.shiftleft(more, 20) + last
    base = (F.col("rate") / UNIT).cast("int")
    sized = rated.withColumn("rate", rate).select("doc_id", "row", "source_no", "size", "rate", base.alias("base"), place.alias("place"))
    sized = materialize(sized, "mix-rates")
    whole = sized.groupBy("source_no").agg(F.sum(F.col("size") * F.col("base")).alias("whole"))
    room = goals.join(whole, "source_no").select("source_no", (F.round("target").cast("long") - F.col("whole")).alias("room"))
    open_rows = sized.where((F.col("base") < most) & (F.col("size") > 0))
    cut = _threshold(open_rows.select("source_no", "place", "size"), room, "cut")
    extra = (F.col("size") > 0) & (F.col("base") < most) & (F.col("place") < F.col("cut"))
    copies = F.col("base") + extra.cast("int")
    got = sized.join(cut.select("source_no", "cut"), "source_no").select("doc_id", "row", "source_no", "size", "rate", "place", copies.alias("copies"))
    got = _fill(materialize(got, "mix-copies"), cut.select("source_no", "left"), goals, most, tolerance)
    return got.join(goals.select("source_no", "source_size", "target"), "source_no").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", (F.col("rate") / UNIT).alias("rate")
    )


def _fill(rows: DataFrame, left: DataFrame, goals: DataFrame, most: int, tolerance: float) -> DataFrame:
    """One copy more of documents that fit, in rounding order, until sources are near their targets or nothing fits.

    A round ends at a document that does not fit, so what is left falls below a size that did before.
    """
    goal = goals.select("source_no", (F.col("target") * tolerance).alias("slack"))
    left = materialize(left.join(goal, "source_no"), "mix-left")
    while True:
        wanting = left.where("left > slack").select("source_no", "left")
        fits = (F.col("copies") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        able = rows.join(wanting, "source_no").where(fits).select("source_no", "place", "size")
        if able.isEmpty():
            return rows
        cut = _threshold(able, wanting.withColumnRenamed("left", "room"), "fill").withColumnRenamed("left", "still")
        with_cut = rows.join(wanting.join(cut, "source_no"), "source_no", "left")
        more = F.coalesce(fits & (F.col("place") < F.col("cut")), F.lit(False)).cast("int")
        rows = materialize(with_cut.select(*[c for c in rows.columns if c != "copies"], (F.col("copies") + more).alias("copies")), "mix-copies")
        left = left.join(cut, "source_no", "left").select("source_no", F.coalesce("still", "left").alias("left"), "slack")
        left = materialize(left, "mix-left")
