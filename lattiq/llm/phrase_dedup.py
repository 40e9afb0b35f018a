"""Substring deduplication by repeated-phrase automata.

A passage of ``size`` words that starts in a document with a smaller id too is removed
wherever it occurs again. Recurring passages are confirmed word by word among the
fragments that share an anchor, sharded Aho-Corasick automata are compiled from
them with pyahocorasick (an automaton per batch of anchors, one symbol per word, the
smallest document as its value), and the fragments of all documents that hold those anchors
are streamed through their shard's automaton to locate every occurrence.

A document meets only the shards that its anchors name, so the work grows with the corpus
and not with its square. Defined results: null text has no words; documents shorter than a
window keep all words; of whole copies all but the smallest id go; repeated rows of one
id do not remove each other; null ids come after all others; texts of any length are
read whole, in segments; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from lattiq.llm.passages import BYTE_CODES, Windows, mix, powers, remove_repeats

#: Fixed by the contract: a word is a run without these white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LONG = 1 << 16
_BLOCK = 1 << 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; long ones are hashed one by one."""
    out = np.empty(len(words), np.uint64)
    at = 0
    while at < len(words):
        block, size = [], 0
        while at + len(block) < len(words) and (size < _BLOCK or not block):
            w = words[at + len(block)]
            if len(w) > _LONG:
                w = hashlib.blake2b(w, digest_size=32).digest()
            block.append(w)
            size += len(w)
        lengths = np.array([len(w) for w in block])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        raw = np.frombuffer(b"".join(block), np.uint8)
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_CODES[raw] * up[: len(raw)], out=total[1:])
        out[at : at + len(block)] = mix((total[ends] - total[starts]) * down[starts] + lengths.astype(np.uint64))
        at += len(block)
    return out


def read_words(text: str) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
    words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text)]
    return word_hashes(words), lambda a, b: b" ".join(words[a:b])


def kept_words(text: str, removed: np.ndarray) -> bytes:
    return " ".join(w for w, gone in zip(WORD.findall(text), removed.tolist(), strict=True) if not gone).encode("utf-8", "surrogatepass")


def _symbol(n: int) -> str:
    """The n-th symbol: one code point for each word of a batch, leaving out surrogates."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 0x801)


def locate(size: int):
    """Kernel: confirm passages, compile an automaton, stream the fragments."""

    def kernel(anchors: list[int], contents: list[bytes], docs: list[int], times: list[int], at: list[int]) -> list[list[tuple[int, int, int]]]:
        symbols: dict[bytes, str] = {}
        streams = ["".join([symbols.setdefault(w, _symbol(len(symbols))) for w in c.split(b" ")]) for c in contents]
        least: dict[str, list[int]] = {}
        for stream, doc, n in zip(streams, docs, times, strict=True):
            for i in range(len(stream) - size + 1):
                seen = least.setdefault(stream[i : i + size], [doc, 0])
                seen[0] = min(seen[0], doc)
                seen[1] += n
        automaton = ahocorasick.Automaton()
        for passage, (doc, n) in least.items():
            if n > 1:
                automaton.add_word(passage, doc)
        if not len(automaton):
            return [[] for _ in streams]
        automaton.make_automaton()
        found = []
        for stream in streams:
            marks: list[tuple[int, int, int]] = []
            for end, doc in automaton.iter(stream):
                i = end - size + 1
                if marks and marks[-1][2] == doc and marks[-1][1] == i - 1:
                    marks[-1] = (marks[-1][0], i, doc)
                else:
                    marks.append((i, i, doc))
            found.append(marks)
        return found

    return kernel


def dedup_phrases(docs: DataFrame, size: int = 50, gram: int = 12, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, n_spans."""
    win = Windows(size, gram, read_words)
    got = remove_repeats(docs, win, locate(size), kept_words, earlier_only=True, **options)
    return got.select("doc_id", got.n.alias("n_words"), "n_removed", "kept_sha256", "n_spans")
