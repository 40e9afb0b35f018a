"""Hierarchical residual packing of tokenised documents into fixed-length sequences.

Every document becomes pieces of at most ``capacity`` tokens. The task that encodes a
partition also packs it by best fit, largest piece first. Nearly full bins are final;
bins with room left are the items of the next round, where groups of former partitions
meet and are packed by best fit again. A round has as many groups as its items need at
``group_items`` each, so that no task grows with the corpus, and the rounds end when one
group has seen all that is left or when a round saves no bin.

Defined results: null text counts as empty and is the end token alone; longer documents
give a shorter first piece and full ones after it; repeated rows are packed as often
as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lattiq.llm import bpe
from lattiq.llm.arrow import small_batches
from lattiq.session import materialize

END_ID = 2


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: largest first, into the fullest bin that it fits.

    Bins are kept in stacks by the room they have left; one bit for each stack that is
    not empty makes the search for the least sufficient room a single bit operation.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, 0
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of the pieces of one document; only the first may be short."""
    n = len(ids) // 4
    edges = [0, *range(n % capacity or min(capacity, n), n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:])]


def collect_pieces(batches: Iterator[pa.RecordBatch], encode_batch: Callable[[list], list[bytes]], capacity: int) -> tuple[list[pa.Array], list[np.ndarray]]:
    """Ids and (piece, start, length, checksum) of the pieces of a partition, as arrays a batch.

    The ids are copied: a column that came over a stream keeps its whole batch, texts included.
    """
    end = np.uint32(END_ID).tobytes()
    ids, cols = [], []
    for batch in batches:
        if batch.num_rows:
            found = [(row, no, *piece) for row, got in enumerate(encode_batch(batch.column(1).to_pylist())) for no, piece in enumerate(cut(got + end, capacity))]
            table = np.array(found, np.int64).T
            ids.append(batch.column(0).take(pa.array(table[0])))
            cols.append(table[1:])
    return ids, [np.concatenate(c) for c in zip(*cols, strict=True)]


def encode_and_pack(docs: DataFrame, capacity: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents with the bin and offset that their own partition gave them."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        owner, cols = collect_pieces(batches, bpe.load(path).encode_batch, capacity)
        if not owner:
            return
        piece, start, length, crc = cols
        bins, offsets = best_fit(length, capacity)
        ids = pa.concat_arrays(owner)
        for a in range(0, len(piece), 20_000):
            part = slice(a, a + 20_000)
            yield pa.RecordBatch.from_arrays(
                [ids[part], pa.array(piece[part], pa.int32()), *(pa.array(x[part], pa.int64()) for x in (start, length, crc, base + bins, offsets))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset"],
            )

    return narrow.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long")


def _repack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        bins, offsets = best_fit(pdf["fill"].to_numpy(), capacity)
        name = np.empty(len(pdf), np.int64)
        ids = pdf["bin"].to_numpy()
        name[bins[offsets == 0]] = ids[offsets == 0]
        return pd.DataFrame({"bin": ids, "into": name[bins], "shift": offsets, "fill": pdf["fill"].to_numpy()})

    return run


def merge_rounds(bins: DataFrame, capacity: int, slack: int, group_items: int) -> DataFrame | None:
    """(bin, into, shift) for every bin that later rounds have moved, or None."""
    moved: DataFrame | None = None
    items = bins.where(F.col("fill") < capacity - slack)
    n = items.count()
    for no in itertools.count():
        groups = max(1, -(-n // group_items))
        if n < 2:
            break
        dealt = items.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(no)), F.lit(groups)).cast("int"))
        step = materialize(dealt.groupBy("g").applyInPandas(_repack(capacity), "bin long, into long, shift long, fill long"), "packing-round")
        if moved is None:
            moved = step.select("bin", "into", "shift")
        else:
            old, new = moved.alias("o"), step.alias("n")
            moved = materialize(
                old.join(new, F.col("o.into") == F.col("n.bin"), "left").select(
                    "o.bin", F.coalesce("n.into", "o.into").alias("into"), (F.col("o.shift") + F.coalesce("n.shift", F.lit(0))).alias("shift")
                ),
                "packing-moves",
            )
        filled = step.groupBy(F.col("into").alias("bin")).agg(F.sum("fill").alias("fill"))
        items = filled.where(F.col("fill") < capacity - slack)
        bins_left, left = filled.agg(F.count(F.lit(1)), F.count_if(F.col("fill") < capacity - slack)).first()
        if groups == 1 or bins_left == n:
            break
        n = left
    return moved


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    slack: int = 0,
    group_items: int = 100_000,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Bins with at most *slack* free tokens are final at once; *group_items* bounds what
    one task of a later round packs.
    """
    pieces = materialize(encode_and_pack(docs, capacity, path or bpe.default_path(), id_col, text_col), "pieces")
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    moved = merge_rounds(bins, capacity, slack, group_items)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    return pieces.join(moved, "bin", "left").select(
        *out, F.coalesce("into", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
