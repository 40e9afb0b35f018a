"""Spelling variants: words at one edit from a much more frequent word, by a variable-length gram index.

1. ``count_words``: per task the words of whole texts are counted, and counts meet by word.
2. ``gram_dictionary``: grams of ``qmin`` to ``qmax`` characters of all words (with a mark at
   either end) are counted; a gram is extended to longer ones only while it is frequent, so
   the dictionary is the set of frequent grams, whose number is bounded by ``max_grams``.
3. ``postings``: a word has one gram at each position, the longest that the dictionary leads
   to. An edit can only affect the grams whose characters it touches. The most grams that
   any single edit of a word affects, plus one, is how many of its lists must be merged: a
   word at one edit shares one of them at least, so the rarest ones are taken and the
   long lists are left out.
4. ``near_pairs``: each list (a gram at a position, in words of a length or one more) is merged
   in a task, and all pairs in it are verified at once over byte matrices. A list of more than
   ``block_rows`` words is dealt to block pairs by hash, which together meet all its pairs.
5. ``variants``: the most frequent near word is the form, if it is ``factor`` times as frequent;
   roots follow forms by pointer doubling.

Letters are ``[A-Za-z\\u00C0-\\u00FF]``, so a character is one byte here. Defined results: null
text has no words; a null id counts as empty in the deletion rule; repeated rows count
again; words and texts of any length are read whole; ties go to the smaller word in
code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattiq.llm.arrow import small_batches
from lattiq.llm.passages import mix
from lattiq.session import materialize, shuffle_partitions

#: Fixed by the contract: what a run of letters is, and that only A-Z are lower-cased.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows a task holds before it sends or compares them.
_HELD = 1 << 18
#: Bytes of a word that are compared as a matrix row; longer words are compared one by one.
_WIDTH = 40
_FIRST, _LAST = b"\x01", b"\x02"


def lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def thin_out(prefix: int, run: str, every: int) -> str:
    """The run, less one letter where *every* divides its checksum; *prefix* is the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own: dict[str, int] = {}
                for raw, n in Counter(LETTERS.findall(text or "")).items():
                    if len(raw) >= min_length:
                        word = thin_out(prefix, lower(raw), every)
                        own[word] = own.get(word, 0) + n
                for word, n in own.items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > _HELD:
                    yield send()
        if held:
            yield send()

    small_batches(docs.sparkSession)
    counts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Grams:
    """All grams of a batch of words: a code for each start and length, 0 where the word ends before."""

    def __init__(self, words: list[bytes], qmin: int, qmax: int) -> None:
        size = np.array([len(w) + 2 for w in words], np.int64)
        self.ends = np.cumsum(size)
        self.first = self.ends - size
        raw = np.frombuffer(b"".join(_FIRST + w + _LAST for w in words), np.uint8).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), size)
        self.at = np.arange(len(raw)) - self.first[self.word]
        room = self.ends[self.word] - np.arange(len(raw))
        self.codes: dict[int, np.ndarray] = {}
        code = np.zeros(len(raw), np.int64)
        padded = np.concatenate((raw, np.zeros(qmax, np.int64)))
        for q in range(1, qmax + 1):
            code = code << 8 | padded[q - 1 : q - 1 + len(raw)]
            if q >= qmin:
                self.codes[q] = np.where(room >= q, code, 0)


def _words_of(batch: pa.RecordBatch) -> list[bytes]:
    return [w.encode("latin-1") for w in batch.column(0).to_pylist()]


def gram_dictionary(words: DataFrame, qmin: int, qmax: int, least: int, max_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the frequent grams, sorted, and their counts; a gram not among them is rare.

    Frequent is above *least* and above the share of all grams that keeps their number, for
    each length, under *max_grams* / (qmax - qmin + 1), as counts of one length add up to
    no more than all positions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams = Grams(_words_of(batch), qmin, qmax)
                code, n = np.unique(np.concatenate([c[c > 0] for c in grams.codes.values()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    positions = words.agg(F.coalesce(F.sum(F.length("word") + 3 - qmin), F.lit(0)).alias("n")).first()["n"]
    floor = max(least, positions * (qmax - qmin + 1) // max_grams)
    counts = words.select("word").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > floor).orderBy("code").collect()  # at most max_grams
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def decompose(words: list[bytes], codes: np.ndarray, counts: np.ndarray, qmin: int, qmax: int) -> tuple[np.ndarray, ...]:
    """The lists to merge, as (word, position, code): of each word the rarest, one more than an edit can affect."""

    def frequency(x: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(x), np.int64)
        k = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
        return np.where(codes[k] == x, counts[k], 0)

    g = Grams(words, qmin, qmax)
    start = np.flatnonzero(g.codes[qmin] > 0)
    code, seen = g.codes[qmin][start], np.full(len(start), qmin)
    often = frequency(code)
    for q in range(qmin + 1, qmax + 1):
        longer = g.codes[q][start]
        grow = (often > 0) & (longer > 0) & (seen == q - 1)
        code, seen = np.where(grow, longer, code), np.where(grow, q, seen)
        often = np.where(grow, frequency(longer), often)
    word, at = g.word[start], g.at[start]
    # how many grams read each character, and the most over a word's characters
    edge = np.zeros(len(g.word) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + seen, -1)
    affected = np.maximum.reduceat(np.cumsum(edge[:-1]), g.first)
    order = np.lexsort((at, mix(code.astype(np.uint64)), often, word))
    begin = np.searchsorted(word[order], np.arange(len(words)))
    rank = np.arange(len(order)) - begin[word[order]]
    chosen = order[rank <= affected[word[order]]]
    return word[chosen], at[chosen], code[chosen]


def _postings(words: DataFrame, qmin: int, qmax: int, least: int, max_grams: int) -> DataFrame:
    """(key, word, n, short): a word stands in the list of its own length and in two of the length below."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, qmin, qmax, least, max_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words_of(batch)
            word, at, code = decompose(words, codes, counts, qmin, qmax)
            length = np.array([len(w) for w in words], np.int64)[word]
            keys = []
            for shift, less in ((0, 0), (0, 1), (1, 1)):
                place = (np.uint64(1 << 32) * (length - less).astype(np.uint64)) + (at - shift + 1).astype(np.uint64)
                keys.append(mix(mix(code.astype(np.uint64)) ^ place).view(np.int64))
            rows = pa.array(np.tile(word, 3))
            short = pa.array(np.repeat([True, False, False], len(word)))
            cols = [pa.array(np.concatenate(keys)), batch.column(0).take(rows), batch.column(1).take(rows), short]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "word", "n", "short"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, short boolean")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether *b* has the length of *a* or one more, and differs by exactly one edit."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k:] == b[k + 1 :]


class Verifier:
    """Words as rows of a byte matrix, to test many pairs at once."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.size = np.array([len(w) for w in words])
        self.table = np.frombuffer(b"".join(w[:_WIDTH].ljust(_WIDTH + 1, b"\0") for w in words), np.uint8).reshape(-1, _WIDTH + 1)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) are at exactly one edit; i is never the longer."""
        out = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 15):
            p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            more = self.size[q] - self.size[p]
            width = min(_WIDTH, int(self.size[q].max()))
            differ = self.table[p, :width] != self.table[q, :width]
            near = (more == 0) & (np.count_nonzero(differ, axis=1) == 1)
            k = np.flatnonzero(more == 1)
            if len(k):
                left = np.where(differ[k].any(1), differ[k].argmax(1), width)  # first place where they differ
                moved = self.table[p[k], :width] != self.table[q[k], 1 : width + 1]
                moved[np.arange(width) >= self.size[p[k]][:, None]] = False
                right = np.where(moved.any(1), width - moved[:, ::-1].argmax(1), 0)  # from here on the rest agrees
                near[k] = right <= left
            for k in np.flatnonzero((self.size[q] > _WIDTH) & (more <= 1)):
                near[k] = one_edit(self.words[p[k]], self.words[q[k]])
            out[s : s + (1 << 15)] = near
        return out


def merge_list(keys: np.ndarray, words: list[bytes], short: np.ndarray, block: np.ndarray, apart: np.ndarray) -> set[tuple[int, int]]:
    """Near pairs among rows of equal key (the rows are sorted by key), each pair of words once.

    Row i meets row i + 1, then i + 2 and so on, for all rows at once. *apart*: rows of two
    blocks of a long list, where only rows of different blocks meet.
    """
    found: dict[tuple[bytes, bytes], tuple[int, int]] = {}
    check = Verifier(words)
    size = check.size
    live, step = np.arange(len(keys)), 1
    while len(live):
        live = live[live + step < len(keys)]
        live = live[keys[live] == keys[live + step]]
        i, j = live, live + step
        meet = (short[i] | short[j]) & (~apart[i] | (block[i] != block[j]))
        i, j = i[meet], j[meet]
        i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
        good = check.near(i, j) if len(i) else np.zeros(0, bool)
        for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
            pair = (a, b) if words[a] < words[b] else (b, a)
            found.setdefault((words[pair[0]], words[pair[1]]), pair)
        step += 1
    return set(found.values())


def near_pairs(words: DataFrame, qmin: int = 2, qmax: int = 5, least: int = 50, max_grams: int = 1_000_000, block_rows: int = 8192) -> DataFrame:
    """(a, b, n_a, n_b) with a < b: all pairs of *words* (word, n) at exactly one edit.

    Every word needs *qmax* letters at least, so that an edit cannot affect all its grams.
    """
    spark = words.sparkSession
    rows = materialize(_postings(words, qmin, qmax, least, max_grams), "spelling-lists")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if("short").alias("own"))
    sizes = sizes.where((F.col("size") > 1) & (F.col("own") > 0))
    # a list without a partner is no list; a long one is dealt to all pairs of its blocks
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    dealt = rows.join(sizes.select("key", blocks.alias("blocks")), "key")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "word", "n", "short", own.alias("block"), other)
    cell = F.struct(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    cells = dealt.select(F.xxhash64("key", cell).alias("cell"), "word", "n", "short", "block", (F.col("block") != F.col("other")).alias("apart"))
    ordered = cells.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell")

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        text, n = rows["word"].to_pylist(), rows["n"].to_pylist()
        cols = [rows[c].to_numpy() for c in ("cell", "short", "block", "apart")]
        pairs = merge_list(cols[0], [w.encode("latin-1") for w in text], *cols[1:])
        got = [(text[a], text[b], n[a], n[b]) for a, b in pairs]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], names=["a", "b", "n_a", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size > _HELD >> 2:  # send what is whole: all but the last key
                cell = batch.column(0).to_numpy()
                if held[-1].column(0)[-1].as_py() != cell[0]:
                    cut = 0
                else:
                    ahead = np.flatnonzero(cell != cell[0])
                    cut = int(ahead[0]) if len(ahead) else batch.num_rows
                if cut < batch.num_rows:
                    yield flush([*held, batch.slice(0, cut)] if cut else held)
                    batch, held, size = batch.slice(cut), [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield flush(held)

    found = ordered.mapInArrow(run, "a string, b string, n_a long, n_b long")
    return found.dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(hop, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step, "spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, factor: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n; *options* go to :func:`near_pairs`."""
    if min_length < options.get("qmax", 5):
        raise ValueError("words need at least qmax letters")
    words = materialize(count_words(docs, min_length, min_count, every, id_col, text_col), "spelling-words")
    pairs = materialize(near_pairs(words, **options), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = F.min_by(F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")), F.struct(-F.col("near_n"), "near"))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = F.col("best.form_n") >= factor * F.col("n")
    placed = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, F.col("best.form_n")).alias("form_n")
    )
    placed = materialize(placed, "spelling-forms")
    ends = roots(placed.where("form IS NOT NULL"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
