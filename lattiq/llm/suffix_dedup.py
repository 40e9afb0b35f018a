"""Byte-level substring deduplication by threshold-bounded interval expansion on a BWT.

A string of ``size`` bytes that starts anywhere else too is removed wherever it
occurs. The fragments that share an anchor form a shard text; its suffixes are sorted,
and its Burrows-Wheeler transform is expanded breadth first: an interval of suffixes
that begin with some string is extended backwards by each byte, which sets the common
prefix lengths at interval ends by increasing value, and the search stops at ``size``.
Suffixes whose common prefix with a neighbour is still unset there share ``size`` bytes.

Defined results: null text counts as empty; texts shorter than ``size`` bytes keep all;
whole copies go altogether, the first one too; repeated rows count as copies; texts of
any length are read whole, in segments; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from lattiq.llm.passages import BYTE_CODES, Windows, remove_repeats


def read_bytes(text: str) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
    raw = text.encode("utf-8", "surrogatepass")
    return BYTE_CODES[np.frombuffer(raw, np.uint8)], lambda a, b: raw[a:b]


def kept_bytes(text: str, removed: np.ndarray) -> bytes:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)[~removed].tobytes()


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; *codes* ends every string with a code of its own.

    Each round sorts only the suffixes whose rank is still shared.
    """
    n, base = len(codes), int(codes.max()) + 2
    bits = n.bit_length()
    packed = 1
    while base ** (packed + 1) < 2**62 and packed < 8:
        packed += 1
    padded = np.concatenate([codes + 1, np.zeros(packed, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key = key * base + padded[k : k + n]
    order = np.argsort(key)  # equal keys get one rank, so their order does not matter
    key = key[order]
    slots, rank, reach = np.arange(n), np.zeros(n + 1, np.int64), packed
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = group + 1
        shared = ~(new & np.append(new[1:], True))
        slots, group = slots[shared], group[shared]
        if not len(slots):
            return order
        at = order[slots]
        key = group << bits | rank[np.minimum(at + reach, n)]
        key, order[slots] = _sort_pairs(key, at, 2 * bits, bits)
        reach *= 2


def _sort_pairs(key: np.ndarray, value: np.ndarray, key_bits: int, value_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both columns by key, then value; as single integers where they fit, which sorts faster."""
    if key_bits + value_bits < 64:
        both = np.sort(key << value_bits | value)
        return both >> value_bits, both & ((1 << value_bits) - 1)
    order = np.lexsort((value, key))
    return key[order], value[order]


def bounded_lcp(codes: np.ndarray, order: np.ndarray, symbols: int, limit: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in *order*; -1 where it is *limit* or more.

    Codes below *symbols* are bytes; those from there on end the strings and occur once.
    """
    n = len(codes)
    bwt = codes[order - 1]  # the code before each suffix
    to = np.empty(n, np.int64)
    to[np.argsort(bwt, kind="stable")] = np.arange(n)  # place of the suffix one byte longer
    run = np.cumsum(np.diff(bwt, prepend=bwt[0]) != 0)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    # prefixes of up to `known` codes are compared directly; the expansion begins where those intervals end
    known = min(8, limit)
    same, at = np.ones(n - 1, bool), np.append(codes, np.full(known, -1))
    for length in range(known):
        here = at[order + length]
        differ = same & (here[1:] != here[:-1])
        lcp[1:n][differ] = length
        same &= ~differ
    starts = np.flatnonzero(lcp[:n] >= 0)
    ends = np.append(starts[1:], n)
    last = lcp[ends] == known - 1
    low, high = starts[last], ends[last]
    bits = n.bit_length()
    for length in range(known, limit):
        if not len(low):
            break
        # an interval with one code before all of its rows is extended as a whole
        plain = run[low] == run[high - 1]
        begin, end = low[plain], high[plain]
        real = bwt[begin] < symbols
        left = to[begin[real]]
        right = left + (end - begin)[real]
        # the rows of the others are grouped by interval and code
        begin, end = low[~plain], high[~plain]
        if len(begin):
            sizes = end - begin
            owner = np.repeat(np.arange(len(begin)), sizes)
            rows = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
            code = bwt[rows]
            real = code < symbols
            key, target = _sort_pairs(owner[real] * symbols + code[real], to[rows[real]], (len(begin) * symbols).bit_length(), bits)
            new = np.flatnonzero(np.diff(key, prepend=-1))
            left = np.concatenate((left, target[new]))
            right = np.concatenate((right, target[new] + np.diff(np.append(new, len(key)))))
        fresh = lcp[right] == -1
        low, high = left[fresh], right[fresh]
        lcp[high] = length
    return lcp[:n]


def may_repeat(contents: list[bytes], at: list[int], gram: int, size: int) -> list[bool]:
    """Which fragments of one anchor can share a string of *size* bytes with another.

    Around the anchor a fragment agrees with any other at most as far as with its
    neighbours in the order of what follows and in the order of what precedes. Where an
    anchor stands several times, a fragment can repeat itself, and all are kept.
    """
    if min(at) < 0:
        return [True] * len(contents)
    reach = [gram] * len(contents)
    for sides in ([c[a + gram :] for c, a in zip(contents, at, strict=True)], [c[:a][::-1] for c, a in zip(contents, at, strict=True)]):
        order = sorted(range(len(sides)), key=sides.__getitem__)
        far = [0] * len(sides)
        for x, y in itertools.pairwise(order):
            n = len(os.path.commonprefix((sides[x], sides[y])))
            far[x], far[y] = max(far[x], n), max(far[y], n)
        reach = [r + f for r, f in zip(reach, far, strict=True)]
    return [r >= size for r in reach]


def expand(size: int, gram: int):
    """Kernel: windows of the fragments that start elsewhere too.

    A fragment that occurs several times is repeated as a whole; those that can share
    a string with another fragment of their anchor are expanded together.
    """

    def kernel(anchors: list[int], contents: list[bytes], docs: list[int], times: list[int], at: list[int]) -> list[list[tuple[int, int, int]]]:
        found: list[list[tuple[int, int, int]]] = [[(0, len(c) - size, 0)] if n > 1 else [] for c, n in zip(contents, times, strict=True)]
        owner: list[int] = []
        for _, group in itertools.groupby(range(len(anchors)), anchors.__getitem__):
            g = list(group)
            may = may_repeat([contents[i] for i in g], [at[i] for i in g], gram, size)
            some = [i for i, m in zip(g, may, strict=True) if m]
            owner += some if any(times[i] == 1 for i in some) else []
        if not owner:
            return found
        texts = [contents[i] for i in owner]
        lengths = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        used, dense = np.unique(raw, return_inverse=True)
        symbols = len(used)
        codes = dense.astype(np.int64)
        codes[ends - 1] = symbols + np.arange(len(texts))
        order = suffix_order(codes)
        shared = bounded_lcp(codes, order, symbols, size) == -1
        repeated = np.zeros(len(codes), bool)
        repeated[order[shared]] = True
        repeated[order[np.flatnonzero(shared) - 1]] = True
        step = np.diff(repeated.astype(np.int8), prepend=0, append=0)
        on, off = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
        text_no = np.searchsorted(ends, on, side="right")
        for a, b, t in zip(on.tolist(), off.tolist(), text_no.tolist(), strict=True):
            if times[owner[t]] == 1:
                start = int(ends[t] - lengths[t])
                found[owner[t]].append((a - start, b - start, 0))
        return found

    return kernel


def dedup_bytes(docs: DataFrame, size: int = 400, gram: int = 64, batch_bytes: int = 1 << 18, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    *batch_bytes*: about what one BWT holds; small ones stay in the processor's caches.
    """
    win = Windows(size, gram, read_bytes)
    got = remove_repeats(docs, win, expand(size, gram), kept_bytes, earlier_only=False, batch_bytes=batch_bytes, **options)
    return got.select("doc_id", got.n.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
