"""The thin ``opN_<name>`` queries over the input tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, jaccard, language, mpegts, negatives, ngram_lm, oracles, packing, pii, quality, secrets, sharding, tokens, toxicity
from .common import fold, read

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("_spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text(F.col("_spans")).alias("spans"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.round(F.array_max(F.transform("_spans", lambda s: s["score"])), 6).alias("best_score"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.array_join("evidence", ",").alias("evidence"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"), jaccard.Similarity(ngram=4, numerator=85, denominator=100))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(read(spark, sf_dir, "documents"), vocabulary())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 3) == 1
    found = language.identify(docs, language.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_documents(docs, secrets.train(docs))


def op8_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_digests(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("is_anchor")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.score_documents(docs, fold("doc_id", 10) == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_quality, op3_toxicity, op4_jaccard, op5_bpe, op6_language, op7_secrets, op8_mpegts, op9_packing, op10_sharding, op11_hard_negatives, op12_divergence, op13_language_model)
}

#: The others hold models, token ids or stored bytes, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {
    "op1_pii": oracles.PII,
    "op2_quality": oracles.QUALITY,
    "op4_jaccard": oracles.JACCARD,
    "op10_sharding": oracles.SHARDING,
    "op11_hard_negatives": oracles.NEGATIVES,
    "op12_divergence": oracles.DIVERGENCE,
}
