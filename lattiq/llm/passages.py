"""Finding windows of consecutive units that occur elsewhere, for units of any kind.

Shared by the two passage operators (windows of words, windows of bytes). Every window is
routed by its *anchor*, the least hash among its grams: equal windows have equal
anchors, so two windows that are equal meet under one key, while a text sends only about
two keys for each window length. The steps:

1. ``profile``: per document its size, digest and anchors. Whole copies are grouped by the
   digest, and one document stands for all of them from there on.
2. ``recurring``: anchors that occur twice or more; only these go on.
3. ``fragments``: the text around each recurring anchor, that is, the run of windows
   that have it. Equal fragments are collapsed before they meet.
4. A kernel, given by the operator, decides the windows of each anchor's fragments.
   An anchor with very many fragments is not gathered: its windows are dealt by their own
   hashes to as many groups as it needs, and windows that agree in 128 bits are counted there.
5. Window verdicts go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattiq.llm.arrow import map_batches, small_batches
from lattiq.session import materialize, shuffle_partitions

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_OTHER = _U(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least *n* of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, _U)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of *size* units, the same wherever the run stands."""
    up, down = powers(len(units) + 1)
    total = np.zeros(len(units) + 1, _U)
    np.cumsum(units * up[: len(units)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(units) - size + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


@dataclass(frozen=True)
class Windows:
    """What a window is: *units* of a text, *size* of them, with anchors of *gram* units."""

    size: int
    gram: int
    read: Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]  # unit hashes; content of units [a, b)

    @property
    def width(self) -> int:
        return self.size - self.gram + 1

    def runs(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(offset, gram hashes, run starts, run ends, run anchors) by segment; a run is of windows with one anchor."""
        last = len(units) - self.size + 1
        for s in range(0, max(0, last), _SEGMENT):
            part = units[s : s + _SEGMENT + self.size - 1]
            grams = gram_hashes(part, self.gram)
            least = sliding_min(grams, self.width)
            starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
            ends = np.append(starts[1:], len(least))
            if (ends - starts).max() > self.width:  # only periodic text has such runs
                pieces = [np.arange(a, b, self.width) for a, b in zip(starts, ends, strict=True)]
                starts = np.concatenate(pieces)
                ends = np.append(starts[1:], len(least))
            yield s, grams, starts, ends, least[starts]


def _profile(docs: DataFrame, win: Windows, within: bool) -> DataFrame:
    """Per row: key, doc_id, n units, sha of the units' content, anchors with their occurrences."""

    def apply(rows: dict) -> dict:
        n, sha, anchors = [], [], []
        for text in rows["text"]:
            units, content = win.read(text or "")
            n.append(len(units))
            sha.append(hashlib.sha256(content(0, len(units))).hexdigest())
            seen: dict[int, int] = {}
            for _, grams, starts, ends, values in win.runs(units):
                for a, b, v, signed in zip(starts.tolist(), ends.tolist(), values, values.view(np.int64).tolist(), strict=True):
                    times = int(np.count_nonzero(grams[a : b + win.width - 1] == v)) if within else 1
                    seen[signed] = seen.get(signed, 0) + times if within else 1
            anchors.append([{"anchor": k, "times": t} for k, t in seen.items()])
        return {"key": rows["key"], "doc_id": rows["doc_id"], "n": n, "sha": sha, "anchors": anchors}

    return map_batches(docs, apply, "key long, doc_id long, n long, sha string, anchors array<struct<anchor:long,times:int>>")


def _fragments(docs: DataFrame, win: Windows, hot: int) -> DataFrame:
    """Per run of windows with a recurring anchor: its content, or, under a hot anchor, its windows' hashes."""

    def apply(rows: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("key", "doc_id", "anchor", "start", "hash", "content", "hashes", "again", "deal", "at")}
        for key, doc_id, text, wanted in zip(rows["key"], rows["doc_id"], rows["text"], rows["wanted"], strict=True):
            times = {w["anchor"]: w["times"] for w in wanted}
            units, content = win.read(text or "")
            for s, grams, starts, ends, values in win.runs(units):
                for a, b, v in zip(starts.tolist(), ends.tolist(), values.view(np.int64).tolist(), strict=True):
                    if v not in times:
                        continue
                    is_hot = times[v] > hot
                    part = content(s + a, s + b - 1 + win.size)
                    name = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                    own = units[s + a : s + b - 1 + win.size]
                    hashes = gram_hashes(own, win.size).view(np.int64) if is_hot else None
                    again = gram_hashes(mix(own ^ _OTHER), win.size).view(np.int64) if is_hot else None
                    places = np.flatnonzero(grams[a : b - 1 + win.width].view(np.int64) == v)
                    at = int(places[0]) if len(places) == 1 else -1
                    row = (key, doc_id, v, s + a, name, None if is_hot else part, hashes, again, -(-times[v] // hot), at)
                    for k, x in zip(out, row, strict=True):
                        out[k].append(x)
        return out

    return map_batches(docs, apply, "key long, doc_id long, anchor long, start long, hash long, content binary, hashes array<long>, again array<long>, deal int, at int")


Kernel = Callable[[list[int], list[bytes], list[int], list[int], list[int]], list[list[tuple[int, int, int]]]]
_MARKS = "array<struct<lo:int,hi:int,doc:long>>"
_MARKS_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("doc", pa.int64())]))


def _mark_batch(anchors: list[int], names: list[int], marks: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    rows = [[{"lo": a, "hi": b, "doc": d} for a, b, d in m] for m in marks]
    return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(names, pa.int64()), pa.array(rows, _MARKS_TYPE)], names=["anchor", "hash", "marks"])


def _decide(parts: DataFrame, kernel: Kernel, batch_bytes: int) -> DataFrame:
    """Run the kernel over whole groups of one anchor, several groups at a time.

    It gets, for each distinct fragment, its anchor, content, smallest document, number of
    occurrences, and the unit its anchor begins at (-1 if it has several); it returns
    runs (first window, last window, smallest document).
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        anchors, names, *rest = (list(c) for c in zip(*rows, strict=True))
        return _mark_batch(anchors, names, kernel(anchors, *rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= batch_bytes and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield flush(held)

    n = shuffle_partitions(parts.sparkSession)
    sorted_parts = parts.repartition(n, "anchor").sortWithinPartitions("anchor")
    return sorted_parts.mapInArrow(run, f"anchor long, hash long, marks {_MARKS}")


def _spread(runs: DataFrame) -> DataFrame:
    """Verdicts on the distinct runs (anchor, hash, hashes, again, doc_id, times, deal) of hot anchors.

    A run is dealt to ``deal`` parts by its windows' hashes, so equal windows of an anchor
    meet in one group, and a group has about as many windows as an ordinary anchor's.
    """
    parts = runs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    windows = F.transform(F.arrays_zip("hashes", "again"), lambda x, i: F.struct(x["hashes"].alias("h"), x["again"].alias("g"), i.alias("i")))
    pick = F.filter(windows, lambda x: F.pmod(x["h"], F.col("deal")) == F.col("part"))
    parts = parts.select("anchor", "part", "hash", "doc_id", "times", pick.alias("w"))
    parts = parts.select("anchor", "part", "hash", "doc_id", "times", *[F.col("w")[c].alias(c) for c in "hgi"])
    n = shuffle_partitions(runs.sparkSession)
    dealt = parts.where(F.size("h") > 0).repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        sizes = [len(r[5]) for r in rows]
        hashes, again = (np.concatenate([np.array(r[k], np.int64) for r in rows]) for k in (5, 6))
        docs = np.repeat(np.array([r[3] for r in rows], np.int64), sizes)
        times = np.repeat(np.array([r[4] for r in rows], np.int64), sizes)
        order = np.lexsort((docs, again, hashes))
        differ = [x[order][1:] != x[order][:-1] for x in (hashes, again)]
        first = np.flatnonzero(np.concatenate(([True], differ[0] | differ[1])))
        lengths = np.diff(np.append(first, len(order)))
        least, total = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        least[order] = np.repeat(docs[order][first], lengths)
        total[order] = np.repeat(np.add.reduceat(times[order], first), lengths)
        marks, at = [], 0
        for r, size in zip(rows, sizes, strict=True):
            marks.append([(i, i, d) for i, d, t in zip(r[7], least[at : at + size].tolist(), total[at : at + size].tolist(), strict=True) if t > 1])
            at += size
        return _mark_batch([r[0] for r in rows], [r[2] for r in rows], marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, f"anchor long, hash long, marks {_MARKS}")


def remove_repeats(
    docs: DataFrame,
    win: Windows,
    kernel: Kernel,
    join_kept: Callable[[str, np.ndarray], bytes],
    earlier_only: bool,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot: int = 4096,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Per row: key, doc_id, n, n_removed, n_spans, kept_sha256.

    *earlier_only*: a window goes if it starts in a document with a smaller id too; otherwise
    if it starts anywhere else. *hot*: occurrences above which an anchor's windows are
    spread by hash. *batch_bytes* bounds what a kernel call gets, but for one anchor's
    fragments, of which there are at most *hot*.
    """
    small_batches(docs.sparkSession)
    never = (1 << 63) - 1  # null ids come after all others
    keyed = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(never)).alias("doc_id"), F.col(text_col).alias("text")
    )
    profile = materialize(_profile(keyed, win, not earlier_only), "passage-profile")
    # whole copies
    groups = profile.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "key")).alias("first"))
    groups = groups.where("copies > 1")
    placed = profile.select("key", "doc_id", "n", "sha").join(groups, "sha", "left")
    twin = F.col("doc_id") > F.col("first.doc_id") if earlier_only else F.col("copies") > 1
    whole = F.coalesce(twin, F.lit(False)) & (F.col("n") >= win.size)
    own = ["doc_id", "key"]  # an id and a hash of it with the text name a row
    others = placed.where(F.col("first").isNotNull() & (F.struct(*own) != F.col("first"))).select(*own).distinct()
    # anchors that recur
    stands = profile.where(F.col("n") >= win.size).join(others, own, "left_anti")
    anchors = stands.select(*own, F.explode("anchors").alias("a")).select(*own, "a.anchor", "a.times").distinct()
    recurring = anchors.groupBy("anchor").agg(F.sum("times").cast("int").alias("times")).where("times > 1")
    wanted = anchors.select(*own, "anchor").join(recurring, "anchor").groupBy(*own).agg(F.collect_list(F.struct("anchor", "times")).alias("wanted"))
    pieces = materialize(_fragments(keyed.join(wanted, own), win, hot), "passage-fragments")
    # ordinary anchors: the kernel decides; hot ones: their windows are dealt to several groups. Equal runs are one
    first = [F.first(c).alias(c) for c in ("content", "hashes", "again", "deal", "at")]
    parts = pieces.groupBy("anchor", "hash").agg(*first, F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).cast("int").alias("times"))
    parts = materialize(parts, "passage-parts")
    decided = _decide(parts.where("content IS NOT NULL").select("anchor", "hash", "content", "doc_id", "times", "at"), kernel, batch_bytes)
    verdicts = decided.unionByName(_spread(parts.where("hashes IS NOT NULL"))).where(F.size("marks") > 0)
    marks = pieces.select("key", "doc_id", "start", "anchor", "hash").join(verdicts, ["anchor", "hash"])
    if earlier_only:
        marks = marks.withColumn("marks", F.filter("marks", lambda m: m["doc"] < F.col("doc_id")))
    shifted = F.transform("marks", lambda m: F.struct((F.col("start") + m["lo"]).alias("lo"), (F.col("start") + m["hi"]).alias("hi")))
    gone = marks.where(F.size("marks") > 0).select(*own, shifted.alias("gone")).groupBy(*own).agg(F.flatten(F.collect_list("gone")).alias("gone"))

    def cut(rows: dict) -> dict:
        out: dict[str, list] = {"doc_id": rows["doc_id"], "key": rows["key"], "n_removed": [], "n_spans": [], "cut_sha": []}
        for text, gone in zip(rows["text"], rows["gone"], strict=True):
            units, _ = win.read(text or "")
            edge = np.zeros(len(units) + 1, np.int64)
            np.add.at(edge, [g["lo"] for g in gone], 1)
            np.add.at(edge, [g["hi"] + win.size for g in gone], -1)
            removed = np.cumsum(edge[:-1]) > 0
            out["n_removed"].append(int(removed.sum()))
            out["n_spans"].append(int((np.diff(removed.astype(np.int8), prepend=0) == 1).sum()))
            out["cut_sha"].append(hashlib.sha256(join_kept(text or "", removed)).hexdigest())
        return out

    touched = keyed.join(gone, own).dropDuplicates(own)
    trimmed = map_batches(touched.select(*own, "text", "gone"), cut, "doc_id long, key long, n_removed long, n_spans long, cut_sha string")
    none = hashlib.sha256(b"").hexdigest()
    nothing = F.lit(0).cast("long")
    return placed.withColumn("whole", whole).join(trimmed, own, "left").select(
        F.when(F.col("doc_id") < never, F.col("doc_id")).alias("doc_id"),
        "n",
        F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("n_removed", nothing)).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", nothing)).alias("n_spans"),
        F.when(F.col("whole"), F.lit(none)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
