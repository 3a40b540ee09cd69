"""Audit of the sources of a language: which words a source uses more, and how far its words lie from each other source's.

Terms are runs of letters and of anything beyond ASCII.  Each language keeps the
terms that enough of its documents hold.  A group is a (language, source); the
probability of a kept term, in parts of 10^9, is smoothed by two occurrences, so it
depends on the term's count alone within a group.  The difference of two
probabilities is f(p, q) = floor((p - q)^2 / (p + q)).

The terms that mark a group are searched from above: its terms fall in
buckets of counts; within a bucket p is at most that of its greatest count and
the language's probability q at least that of its rarest term, which bounds f for all
of it.  Buckets are evaluated in rounds from the greatest bound on, and a group ends once
all it has not seen is bounded strictly below its k-th value.

Pairs of sources come from the postings of the terms: a term that only one of two
sources holds counts by the histogram of counts of that source, and terms that both
hold are joined.

All numbers are whole; counts are multiplied in decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released


@dataclass(frozen=True)
class Audit:
    """Parameters of the audit."""

    #: A term is kept if so many documents of its language hold it.
    min_documents: int = 10
    top: int = 10
    #: Buckets for each doubling of the count.
    buckets: int = 4
    #: Distinct terms that a task holds before it gives its counts on.
    held: int = 300_000


#: A-Z in small letters and all other ASCII as blanks, so that splitting gives the terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, documents long"


def count_terms(docs: DataFrame, held: int = Audit.held) -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of each term of a group, summed over all tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in groups.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array((documents[t] for t in n), pa.int64(), size=len(n))], [c.split()[0] for c in _COUNTS.split(", ")])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, documents = groups.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.encode().translate(_TERMS).split())
                n.update(own)
                documents.update(own.keys())
            if sum(len(n) for n, _ in groups.values()) > held:
                yield from flush()
        yield from flush()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = plain.mapInArrow(released(count), _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def probability(n: F.Column, total: F.Column, kept: F.Column) -> F.Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)); 1 where a language keeps nothing."""
    top = (n + 2).cast("decimal(24,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    whole = F.call_function("div", top, F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(20,0)"))
    return F.coalesce(whole, F.lit(0)) + 1


def difference(p: F.Column, q: F.Column) -> F.Column:
    """floor((p - q)^2 / (p + q)) of longs up to 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, params: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text).

    Part ``pair``: every other source of the language, with the sum of f over
    the language's kept terms.  Part ``term``: the ``top`` terms that the
    group uses more than its language, by f.  Null language, source and text count as
    empty.  A group without terms is still one, with pairs but no terms; where a language
    keeps no term all its pairs have value 0; a source without others in its
    language has no pair.  Equal values rank by the item's bytes.  Repeated rows count
    each; an empty table gives no row; further columns are left out.
    """
    docs = docs.select("lang", "source", "text")
    counts = materialize(count_terms(docs, params.held), "divergence-counts")
    # Groups without terms are in no row of the counts.
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("_d")).where(F.col("_d") >= params.min_documents).drop("_d")
    by_lang = materialize(by_lang, "divergence-kept")
    langs = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    postings = materialize(counts.drop("documents").join(by_lang, ["lang", "term"]), "divergence-postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total", "held"])
    groups = materialize(groups.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("kept"))), "divergence-groups")
    return _pairs(postings, groups).unionByName(_terms(postings, groups, params))


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum of f over all kept terms for both directions of each pair of sources.

    As if no term were in both: the terms of either source against the other's
    probability of an unseen term, and the rest unseen in both; terms in both
    then replace what was counted for them.
    """
    with_p = postings.join(groups.select("lang", "source", "total", "kept", "p0"), ["lang", "source"]).select("lang", "term", "source", probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "p0")
    histogram = with_p.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("held_b"))
    alone = histogram.join(other, "lang").where("source != item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * difference(F.col("p"), F.col("q0"))).alias("_one"))

    low, high = with_p.withColumnRenamed("source", "a"), with_p.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    gain = difference(p, q) - difference(p, q0) - difference(p0, q) + difference(p0, q0)
    both = low.join(high, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gain).alias("gain"))

    a = groups.select("lang", F.col("source").alias("a"), "kept", F.col("held").alias("held_a"), "p0")
    pairs = a.join(other.withColumnRenamed("item", "b"), "lang").where("a < b")
    for here, there, name in (("a", "b", "one_a"), ("b", "a", "one_b")):
        pairs = pairs.join(alone.select("lang", F.col("source").alias(here), F.col("item").alias(there), F.col("_one").alias(name)), ["lang", "a", "b"], "left")
    pairs = pairs.join(both, ["lang", "a", "b"], "left").na.fill(0, ["one_a", "one_b", "gain"])
    value = F.col("one_a") + F.col("one_b") + F.col("gain") + (F.col("kept") - F.col("held_a") - F.col("held_b")) * difference(p0, q0)
    pairs = materialize(pairs.select("lang", "a", "b", value.alias("value")), "divergence-pairs")
    ways = [pairs.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")]
    return _ranked(ways[0].unionByName(ways[1]), "pair")


def _terms(postings: DataFrame, groups: DataFrame, params: Audit) -> DataFrame:
    """Best-first search of the terms with the greatest f, bucket by bucket."""
    spark = postings.sparkSession
    known = postings.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"]).select(
        "lang", "source", "term",
        probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"), probability(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
        F.floor(F.log2(F.col("n").cast("double")) * params.buckets).cast("int").alias("bucket"),
    )
    known = materialize(known, "divergence-terms")
    top, least = F.max("p").alias("_p"), F.min("q").alias("_q")
    bound = F.when(F.col("_p") > F.col("_q"), difference(F.col("_p"), F.col("_q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    buckets = known.groupBy("lang", "source", "bucket").agg(top, least).select("lang", "source", "bucket", bound.alias("bound")).where("bound IS NOT NULL")
    buckets = materialize(buckets.withColumn("place", F.row_number().over(order)), "divergence-buckets")

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    best = spark.createDataFrame([], "lang string, source string, term string, value bigint, k int")
    ahead, upto = buckets, params.buckets
    while ahead.head(1):
        now = ahead.where(F.col("place") <= upto).select("lang", "source", "bucket")
        value = difference(F.col("p"), F.col("q"))
        seen = known.join(now, ["lang", "source", "bucket"]).where("p > q").select("lang", "source", "term", value.alias("value"))
        best = best.drop("k").unionByName(seen).withColumn("k", F.row_number().over(first)).where(F.col("k") <= params.top)
        best = materialize(best, "divergence-best")
        kth = best.where(F.col("k") == params.top).select("lang", "source", F.col("value").alias("kth"))
        # A bucket whose bound equals the k-th value may still hold an earlier term.
        ahead = buckets.where(F.col("place") > upto).join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth")
        upto *= 2
    return _ranked(best.select("lang", "source", F.col("term").alias("item"), "value"), "term")
