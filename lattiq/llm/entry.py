"""Registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattiq.llm import ann, bpe, chat, hard_negatives, langid, mixing, packing, pii, spelling
from lattiq.llm.ngram_join import jaccard_components
from lattiq.llm.phrase_dedup import dedup_phrases
from lattiq.llm.suffix_dedup import dedup_bytes
from lattiq.llm.exact_dedup import exact_groups
from lattiq.session import materialize, table


def op1_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_phrases(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.train_part(F.col("doc_id"))))
    held_out = ~langid.train_part(F.col("doc_id"))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = materialize(chat.transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    formatted = chat.format_transcripts(written, chat.fit_on(written))
    roles = F.transform("parsed", lambda p: p["role"])
    true = F.transform("turns", lambda t: t["role"])
    return formatted.select(
        "conv_id",
        "segment",
        "style",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("parsed").cast("long").alias("n_parsed"),
        F.array_join(roles, ",").alias("roles"),
        (roles == true).alias("roles_right"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


def op9_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_contextual_pii": op1_contextual_pii,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_repeated_phrases": op4_repeated_phrases,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_language_id": op6_language_id,
        "op7_learned_partitions": op7_learned_partitions,
        "op8_chat_transcripts": op8_chat_transcripts,
        "op9_suffix_intervals": op9_suffix_intervals,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_entropy_mix": op13_entropy_mix,
    }


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_chars FROM w
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict:
    return {"op10_exact_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL}
