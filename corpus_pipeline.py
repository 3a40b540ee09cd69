"""A training-data pipeline over ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All but the last return the columns of ``docs``:

1. toxicity: documents whose score is 0.5 or more go;
2. quality: documents that a base rule or a certified cutoff rejects go;
3. near duplicates: of each group linked by five-word shingles at a similarity
   of 0.8 or more, the smallest id stays;
4. personal data: spans are replaced by their kind in angle brackets, and
   ``n_chars``, where there is one, follows the text;
5. packing: one row for each piece of a document, with its token ids.

Cases: documents with a null id are judged like any other by the first two
stages, cannot be grouped as near duplicates and stay there; rows that repeat an
id are judged and grouped by their own texts, and of rows equal in id and text
the near-duplicate stage keeps one; null and empty texts fail the base rules of
quality; of a group's documents with equal similarity the smallest id stays,
whatever their texts; very long texts are treated as a whole by every stage;
further columns of any name come through all stages but the last as they are;
empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard, packing, pii, quality, queries, toxicity
from palimpsest.llm.common import hint, materialize, read
from palimpsest.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels")))


def _digest() -> F.Column:
    return F.sha2("text", 256)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    sim = jaccard.Similarity(ngram=5, numerator=80, denominator=100)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not ids.head(1):
        gone = materialize(jaccard.near_duplicates(docs, sim).where("component_id < doc_id").select("doc_id"), "pipeline-duplicates")
        # Few ids go to the texts; only beyond a counted size do texts cross a shuffle.
        return docs.join(hint(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)

    # Each further text of a repeated id is grouped under a number above all ids.
    ids = materialize(ids, "pipeline-repeated")
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text", _digest().alias("_digest")).distinct()
    first = texts.groupBy("doc_id").agg(F.min(F.struct("text", "_digest"))["_digest"].alias("_first"))
    top = F.lit(docs.agg(F.max("doc_id")).first()[0]).cast("long")
    texts = texts.join(first, "doc_id").withColumn("_more", ~F.col("_digest").eqNullSafe(F.col("_first")))
    numbered = texts.withColumn("_id", F.when(F.col("_more"), top + 1 + F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("long")))
    numbered = materialize(numbered.select("_id", "doc_id", "text", "_digest"), "pipeline-numbered")
    alone = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti")
    known = alone.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(numbered.select(F.col("_id").alias("doc_id"), "text"))
    found = materialize(jaccard.near_duplicates(known, sim).where("component_id IS NOT NULL"), "pipeline-components")
    found = found.join(numbered.select(F.col("_id").alias("doc_id"), F.col("doc_id").alias("_own"), "_digest"), "doc_id", "left")
    found = found.select("component_id", "doc_id", F.coalesce("_own", "doc_id").alias("_own"), "_digest")
    # The smallest own id of a group stays, and of its texts the one with the smallest number.
    best = found.groupBy("component_id").agg(F.min(F.struct("_own", "doc_id"))["doc_id"].alias("_best"))
    gone = found.join(best, "component_id").where("doc_id != _best")
    kept = found.join(best, "component_id").where("doc_id = _best AND _digest IS NOT NULL").select(F.col("_own").alias("doc_id"), "_digest")
    rest = docs.join(ids, "doc_id", "left_anti").join(gone.where("_digest IS NULL").select(F.col("_own").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    again = docs.join(ids, "doc_id", "left_semi").withColumn("_digest", _digest())
    once = again.join(kept, ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id", "_digest"])
    # Texts in no group stay.
    bare = again.join(found.where("_digest IS NOT NULL").select(F.col("_own").alias("doc_id"), "_digest"), ["doc_id", "_digest"], "left_anti")
    return rest.unionByName(once.select(*docs.columns)).unionByName(bare.select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, queries.vocabulary(), slice_chars=SLICE_CHARS)


#: Workers that ran other stages before hold more, so packing takes less at a time.
SLICE_CHARS = 2_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: The classifiers and the token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
