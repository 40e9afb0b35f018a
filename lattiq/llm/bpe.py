"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A word is held as two contiguous arrays, its parts and the merge ranks of adjacent
parts. The least rank is looked for by a scan, the boundary there is deleted, and the
two ranks beside it are refreshed, until no adjacent pair has a rank. Words of like
byte length are processed together: one numpy column is one word's array, padded at its
end, so a scan, a deletion and a refresh each serve thousands of words. Only words longer
than ``SHORT`` bytes, for which repeated scans would be quadratic, use a heap instead.

Words that a worker has met before come from a bounded cache. The vocabulary is read
from a tokenizer file inside the tasks; its path is a parameter.

Defined results: null text counts as empty and has no ids; strings of added tokens in
a text become those tokens, as in the tokenizer that the file describes; decoding
replaces bytes that are no valid UTF-8, and a text decodes to itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from lattiq.llm.arrow import map_batches

#: Fixed by the vocabulary: how a text is cut into words before merging.
WORDS = regex.compile(r""" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# The same cut for texts of ASCII, Latin letters and plain punctuation, whose classes are spelled out: the
# standard library's engine is faster, and FOREIGN finds the texts that it does not serve.
_LETTER, _DIGIT = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9"
_SPACE = r"\t-\r\x20\x85\xa0"
FOREIGN = re.compile(r"[^\x00-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2010-\u2027\u20ac]")
LATIN_WORDS = re.compile(
    rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
SHORT = 64
#: Words are padded to the next of these byte lengths.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, 48, SHORT)
_NONE = np.int32(2**31 - 1)
#: Words that a worker remembers. Spark keeps more workers than it has cores, and each has a cache.
_CACHED = 50_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _PairTable:
    """Positions of 64-bit keys in an open hash table; lookups of whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, _NONE, np.int32)
        left, slot, self.tries = np.arange(len(keys)), self._slots(keys), 0
        while len(left):
            free = self.keys[slot[left]] < 0
            first = left[free][np.unique(slot[left][free], return_index=True)[1]]  # one key a free slot
            self.keys[slot[first]], self.value[slot[first]] = keys[first], first
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.tries += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or _NONE."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.value[slot], _NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.tries - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            out[left] = np.where(found == keys[left], self.value[slot[left]], _NONE)
            left = left[(found != keys[left]) & (found >= 0)]
        return out


class ByteBpe:
    """Encoder and decoder for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")
        letters = _byte_letters()
        vocab, as_byte = model["vocab"], {c: b for b, c in enumerate(letters)}
        self.bytes_of: dict[int, bytes] = {i: bytes(as_byte[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {a["id"]: a["content"].encode() for a in added}
        self.added = {a["content"]: np.uint32(a["id"]).tobytes() for a in added}
        self.added_at = regex.compile("|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True))) if added else None
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)  # by rank
        self.pairs = _PairTable((left << 32) | right)
        byte_left, byte_right = np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)
        self.byte_ranks = np.append(self.ranks(byte_left, byte_right), _NONE)  # by pair of bytes; the last is padding
        self.cache: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of parts; _NONE where a pair does not merge."""
        return self.pairs.find((left.astype(np.int64) << 32) | right)

    def encode_like(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian bytes, of words that have at most *width* bytes."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        owner = np.repeat(np.arange(n), sizes)
        raw = np.zeros((width, n), np.uint8)
        raw[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = np.frombuffer(b"".join(words), np.uint8)
        pad = np.arange(width)[:, None] >= sizes
        parts = np.where(pad, np.int32(-1), self.byte_id[raw])  # a column a word
        pair = raw[:-1].astype(np.int64) * 256 + raw[1:]
        rank = self.byte_ranks[np.where(pad[1:], 65536, pair)]
        final = np.full((n, width), -1, np.int32)
        place = np.arange(n)
        while len(place):
            least, at = np.full(len(place), _NONE), np.zeros(len(place), np.int64)
            for k, row in enumerate(rank):
                less = row < least
                np.copyto(least, row, where=less)
                at[less] = k
            done = least == _NONE
            if done.any():
                final[place[done], : len(parts)] = parts[:, done].T
                go = ~done
                parts, rank, at, least, place = parts[:, go], rank[:, go], at[go], least[go], place[go]
                if not len(place):
                    break
            col, new = np.arange(len(place)), self.merged[least]
            for k in range(1, len(parts) - 1):  # the boundary after `at` goes
                right = at < k
                np.copyto(parts[k], parts[k + 1], where=right)
                np.copyto(rank[k - 1], rank[k], where=at < k - 1)
            parts, rank = parts[:-1], rank[:-1]
            parts[at, col] = new
            ok = np.flatnonzero(at > 0)
            rank[at[ok] - 1, ok] = self.ranks(parts[at[ok] - 1, ok], new[ok])
            ok = np.flatnonzero(at < len(rank))
            after = parts[at[ok] + 1, ok]
            rank[at[ok], ok] = np.where(after < 0, _NONE, self.ranks(new[ok], np.maximum(after, 0)))
        held = final >= 0
        ends = np.cumsum(held.sum(axis=1)) * 4
        flat = final[held].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, word: bytes) -> bytes:
        """Ids of one long word: the same merges, least rank and leftmost first, from a heap."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids):
                    r = int(self.ranks(np.array([ids[p]]), np.array([ids[q]]))[0])
                    if r != _NONE:
                        heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache does not hold."""
        new = list(words.difference(self.cache))
        if len(self.cache) + len(new) > _CACHED:
            self.cache.clear()
            new = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for i in np.flatnonzero(sizes > SHORT).tolist():
            self.cache[new[i]] = self.encode_long(raw[i])
        widths = np.searchsorted(WIDTHS, sizes)
        for no, width in enumerate(WIDTHS):
            group = np.flatnonzero(widths == no)
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192].tolist()
                self.cache.update(zip(map(new.__getitem__, part), self.encode_like(list(map(raw.__getitem__, part)), width), strict=True))

    def _cut(self, text: str) -> tuple[list[str], list[tuple[int, bytes]]]:
        """Words of a text, and the ids of added tokens with the number of words before each."""
        words = LATIN_WORDS if not FOREIGN.search(text) else WORDS
        if not self.added_at or not self.added_at.search(text):
            return words.findall(text), []
        out: list[str] = []
        added, at = [], 0
        for m in self.added_at.finditer(text):
            out += words.findall(text[at : m.start()])
            added.append((len(out), self.added[m[0]]))
            at = m.end()
        return out + words.findall(text[at:]), added

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, todo, held = [], [], 0
        for text in texts:
            todo.append(self._cut(text or ""))
            held += len(todo[-1][0])
            if held > 200_000:
                out += self._join(todo)
                todo, held = [], 0
        return out + self._join(todo)

    def _join(self, cut: list[tuple[list[str], list[tuple[int, bytes]]]]) -> list[bytes]:
        self.learn(set().union(*(words for words, _ in cut)))
        known, out = self.cache.__getitem__, []
        for words, added in cut:
            parts, at = [], 0
            for n, ids in added:
                parts += [*map(known, words[at:n]), ids]
                at = n
            parts += map(known, words[at:])
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, added tokens included."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The vocabulary, once a worker."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids (array of int), decoded (text of those ids)."""
    path = path or default_path()

    def apply(rows: dict) -> dict:
        bpe = load(path)
        ids = bpe.encode_batch(rows["text"])
        return {"doc_id": rows["doc_id"], "ids": [np.frombuffer(x, "<i4") for x in ids], "decoded": [bpe.decode(x) for x in ids]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), apply, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and texts stay in the task."""
    path = path or default_path()

    def apply(rows: dict) -> dict:
        bpe = load(path)
        ids = bpe.encode_batch(rows["text"])
        return {
            "doc_id": rows["doc_id"],
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), apply, schema)
