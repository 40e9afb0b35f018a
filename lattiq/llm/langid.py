"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts hashed 1- to 3-grams of lower-cased characters per language in Spark;
the resulting (buckets x languages) log-probability matrix is a few MB, whatever the
corpus, and is broadcast. Scoring treats a batch of texts as a sparse matrix in CSR
form (row offsets, bucket ids with count one) and multiplies it by that matrix in numpy.

The fit uses a bounded sample: at most about ``max_docs_per_lang`` labelled documents of
each language, chosen by a hash of the id. Scoring covers every document, whole.

Defined results: null text or text without a letter is ``und`` with score 0; documents
without a language are not learned from; with no labelled document at all everything is
``und``; equal scores go to the alphabetically first language; very long texts are
scored in pieces that overlap by two characters, which gives the sum of the whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lattiq.llm.arrow import map_batches

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Characters scored at once; longer texts are scored piece by piece.
PIECE = 1 << 18
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    log_p: np.ndarray  # (3 * buckets, languages)
    prior: np.ndarray
    buckets: int


def _hashed(codes: np.ndarray, fresh: int, buckets: int) -> np.ndarray:
    """Bucket ids of all n-grams that end at position *fresh* or later; orders have separate ranges."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(3):
        if len(codes) <= n:
            break
        h = (codes if n == 0 else h[:-1] * _MIX[0] + codes[n:]).astype(np.uint32)
        mixed = (h ^ (h >> np.uint32(15))) * _MIX[1]
        mixed = (mixed ^ (mixed >> np.uint32(13))) * _MIX[2]
        ids = (mixed >> np.uint32(7)) & np.uint32(buckets - 1)
        out.append(ids[max(0, fresh - n) :].astype(np.int64) + n * buckets)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _pieces(text: str, buckets: int):
    text = text.lower()
    for at in range(0, len(text), PIECE):
        left = max(0, at - 2)
        codes = np.frombuffer(text[left : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        yield _hashed(codes, at - left, buckets)


def train_part(doc_id: Column) -> Column:
    """Documents that may be learned from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 14, max_docs_per_lang: int = 4000) -> LangModel:
    """Fit on a bounded sample of labelled rows. *buckets* is a power of two."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not sizes:
        return LangModel((), np.zeros((3 * buckets, 0)), np.zeros(0), buckets)
    langs = tuple(sorted(sizes))
    at = {x: i for i, x in enumerate(langs)}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs_per_lang / sizes[k]))])
    u = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(u < share[F.col(lang_col)]).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def count(rows: dict) -> dict:
        table = np.zeros((len(langs), 3 * buckets), np.int64)
        for text, lang in zip(rows["text"], rows["lang"], strict=True):
            for ids in _pieces(text, buckets):
                table[at[lang]] += np.bincount(ids, minlength=3 * buckets)
        lang_no, bucket = np.nonzero(table)
        return {"lang_no": lang_no, "bucket": bucket, "n": table[lang_no, bucket]}

    counts = np.zeros((3 * buckets, len(langs)))
    rows = map_batches(sample, count, "lang_no int, bucket int, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():  # at most 3 x buckets rows a language
        counts[r.bucket, r.lang_no] = r.n
    smooth = 0.5
    totals = np.stack([counts[k * buckets : (k + 1) * buckets].sum(axis=0) for k in range(3)]).repeat(buckets, axis=0)
    seen = max(1, sum(sizes.values()))
    prior = np.log([sizes[k] / seen for k in langs])
    return LangModel(langs, np.log((counts + smooth) / (totals + smooth * buckets)), prior, buckets)


def _score_rows(texts: list[str | None], model: LangModel) -> tuple[list[str], list[float]]:
    """Naive Bayes over a batch: CSR rows of bucket ids times the log-probability matrix."""
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return pred, score
    pending: list[tuple[int, np.ndarray]] = []
    total = np.tile(model.prior, (len(texts), 1))

    def flush() -> None:
        if pending:
            offsets = np.cumsum([0] + [len(ids) for _, ids in pending[:-1]])
            gathered = model.log_p[np.concatenate([ids for _, ids in pending])]
            np.add.at(total, [i for i, _ in pending], np.add.reduceat(gathered, offsets, axis=0))
            pending.clear()

    held = 0
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    for i in known:
        for ids in _pieces(texts[i], model.buckets):
            pending.append((i, ids))
            held += len(ids)
            if held > PIECE:
                flush()
                held = 0
    flush()
    for i in known:
        best = int(np.argmax(total[i]))
        pred[i], score[i] = model.langs[best], 1.0 / float(np.exp(total[i] - total[i][best]).sum())
    return pred, score


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (posterior probability of the answer)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(rows: dict) -> dict:
        pred, score = _score_rows(rows["text"], shared.value)
        return {"doc_id": rows["doc_id"], "lang_pred": pred, "score": score}

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(narrow, apply, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LangModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of *docs*, unchanged, whose language is identified with at least *min_score*."""
    import pyarrow as pa

    from lattiq.llm.arrow import map_in_place, small_batches

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            pred, score = _score_rows(batch.column(at).to_pylist(), shared.value)
            yield batch.filter(pa.array([p != UNKNOWN and s >= min_score for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return map_in_place(docs, run)

