"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only).

Every text is reduced to the SHA-256 digest of its normalised form. Digests form
sorted *runs*; in each round a fixed number of neighbouring runs meet and are merged,
keeping for each digest the count and the verified best row seen so far. After
``log(runs)`` rounds one run of distinct digests is left, spread over all partitions
by digest. The winners then travel down to the base runs, and rows pick theirs up
by (digest, run): a group that holds a third of all rows is spread over all runs on
the way up and on the way down, and no task ever holds a group.

Defined results: null text counts as empty; an empty table gives an empty result;
of rows with as many code points the smallest id stays and null ids come last;
repeated rows (same id and text) each count in ``group_size``; other columns of the
input are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lattiq.llm.arrow import every, unused
from lattiq.session import materialize, shuffle_partitions

#: Fixed by the contract: the white space that does not count.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64) -> DataFrame:
    """One narrow row per document: id, digest, verification length, size, and its run."""
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.octet_length(norm).alias("norm_bytes"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int").alias("run"),
    )


def _best(order: Column) -> Column:
    return F.max(order).alias("best")


def merge_tree(rows: DataFrame, runs: int, fan_in: int = 4) -> tuple[DataFrame, DataFrame]:
    """(base runs, final winners). ``norm_bytes`` beside the digest verifies a match."""
    key = ["digest", "norm_bytes"]
    base = (
        rows.groupBy(*key, "run")
        .agg(F.count(F.lit(1)).alias("n"), _best(F.struct("n_chars", F.bitwise_not(F.col("doc_id").cast("long")).alias("reversed_id"))))
        .sortWithinPartitions("run", "digest")
    )
    base = materialize(base, "digest-runs")
    level, left = base, runs
    while left > 1:
        left = -(-left // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy(*key, "run")
            .agg(F.sum("n").alias("n"), _best(F.col("best")))
        )
    return base, level.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_in: int = 4) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and n_chars."""
    spark = docs.sparkSession
    if runs is None:
        runs = 16
        while runs < shuffle_partitions(spark):
            runs *= fan_in
    rows = materialize(digests(docs, id_col, text_col, runs), "digests")
    base, winners = merge_tree(rows, runs, fan_in)
    key = ["digest", "norm_bytes"]
    won = winners.select(*key, F.col("n").alias("group_size"), F.bitwise_not(F.col("best.reversed_id")).alias("keep_id"))
    down = base.select(*key, "run").join(won, key)
    return rows.join(down, [*key, "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* that stay, with the columns of *docs*.

    A row stays if its id and digest are those of its group's winner; of repeated rows of
    one id and text any one stays. Texts are shuffled once, for the join with the winners.
    """
    won, times = unused(docs, "won"), unused(docs, "times")
    named = F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    kept = materialize(exact_groups(docs, id_col, text_col).where("kept").groupBy(named.alias(won)).agg(F.count(F.lit(1)).alias(times)), "winners")
    own = F.struct(F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    stay = docs.join(kept.where(F.col(times) == 1).select(won), own == F.col(won), "left_semi")
    repeated = kept.where(F.col(times) > 1).select(won)
    if repeated.isEmpty():
        return stay
    row = unused(docs, "row")
    first = docs.join(repeated, own == F.col(won)).groupBy(won).agg(F.first(F.struct(*every(docs))).alias(row))
    return stay.unionByName(first.select(f"{row}.*"))
