"""Quality rules with risk-controlled thresholds (native).

Rules are ratios over a text, larger for worse texts.  For each stratum (the
language), rule and cutoff, the labelled holdout says how many good documents
the cutoff would reject.  A cutoff may be used only if an exact binomial test
shows its false rejection rate to be below ``alpha``: the chance of so few
false rejections, were the rate ``alpha``, must be at most
``delta / (strata * rules * cutoffs)`` (Bonferroni).  With probability
``1 - delta`` no used cutoff rejects more than ``alpha`` of the good documents.
``alpha`` is shared among the rules, so that it also bounds their union.

Among the certified cutoffs of a rule, the one with the best balance of bad
against good rejections is used; a rule that helps nowhere is left out.  A
stratum without certified cutoffs rejects nothing beyond the base rules.

Cases: null text has no words and fails the base rule; rows are judged each by
itself, whatever their ids, so repeats get equal verdicts; of cutoffs with equal
balance the larger is used; very long texts are held as arrays of their words; labels that are null, or of ids that do not occur, are not used;
an id with several labels counts as bad if one of them says so; a null
language is a stratum of its own; an empty table gives no rows; empty labels
leave the base rules only.  ``judge`` returns named columns of its own beside
those asked for; ``keep_good`` returns the columns it was given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hint, materialize

#: Rules over the feature columns, and the cutoffs tried for each.
RULES = {
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "shouting": "n_upper / word_chars",
    "bangs": "n_bangs / n_words",
}
CUTOFFS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9, 1.2, 2.0)
WINDOW = 8


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """Counts for every text, beside the columns in ``keep``.

    Windows are compared by a 64-bit hash; only texts in which one repeats
    (few) sort theirs to find the words covered.
    """
    df = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.expr(f"IF(_t rlike r'[^{SPACE}]', split(btrim(_t, ' \\t\\n\\u000b\\u000c\\r'), r'[{SPACE}]+'), CAST(array() AS array<string>))"))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))

    def left(kept: str) -> Column:
        return F.length(F.regexp_replace("_t", f"[^{kept}]+", "")).cast("long")

    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        left("#*$%&|<>").alias("n_symbols"),
        left("A-Z").alias("n_upper"),
        left("!").alias("n_bangs"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"IF(size(_w) > {window}, transform(sequence(1, size(_w) - {window - 1}), i -> xxhash64(slice(_w, i, {window}))), CAST(array() AS array<bigint>))"
        ).alias("_h"),
    )
    df = df.withColumn(
        "_s", F.expr("IF(size(_h) = size(array_distinct(_h)), NULL, array_sort(transform(_h, (x, i) -> named_struct('h', x, 'i', i))))")
    )
    df = df.withColumn(
        "_p",
        F.expr("array_sort(array_compact(transform(_s, (e, k) -> IF(e.h = get(_s, k - 1).h OR e.h = get(_s, k + 1).h, e.i, NULL))))"),
    )
    covered = f"coalesce(aggregate(transform(_p, (p, k) -> CAST(least({window}, coalesce(get(_p, k + 1) - p, {window})) AS BIGINT)), 0L, (a, x) -> a + x), 0L)"
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("_h", "_s", "_p")


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def _ratio(rule: str) -> Column:
    """A rule's value; null where its denominator is zero."""
    top, bottom = RULES[rule].split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))


def thresholds(labelled: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) of the rules in use, from features with a ``bad`` column.

    One pass sums the rejections of all rules and cutoffs for each stratum;
    the tables that follow have strata x rules x cutoffs rows.
    """
    counts = [F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("good"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("poor")]
    cells = []
    for rule in RULES:
        for k, cutoff in enumerate(CUTOFFS):
            over = F.coalesce(_ratio(rule) > cutoff, F.lit(False))
            counts.append(F.sum(F.when(over & ~F.col("bad"), 1).otherwise(0)).alias(f"f_{rule}_{k}"))
            counts.append(F.sum(F.when(over & F.col("bad"), 1).otherwise(0)).alias(f"t_{rule}_{k}"))
            cells.append(
                F.struct(F.lit(rule).alias("rule"), F.lit(float(cutoff)).alias("cutoff"), F.col(f"f_{rule}_{k}").alias("wrong"), F.col(f"t_{rule}_{k}").alias("right"))
            )
    strata = materialize(labelled.groupBy(F.col(stratum).alias("stratum")).agg(*counts), "quality-strata")
    strata = strata.withColumn("strata", F.lit(max(1, strata.count())))
    each = alpha / len(RULES)
    cells_df = strata.select("stratum", "good", "poor", "strata", F.explode(F.array(*cells)).alias("c")).select("stratum", "good", "poor", "strata", "c.*")
    # P(X <= false) for X ~ Binomial(good, each): terms in logarithms, each from the one before.
    tail = F.expr(
        f"""aggregate(sequence(0L, wrong), named_struct('log', good * ln(1 - {each}D), 'sum', 0D),
            (a, i) -> named_struct(
                'log', a.log + ln(CAST(greatest(good - i, 1L) AS DOUBLE)) - ln(CAST(i + 1 AS DOUBLE)) + ln({each}D / (1 - {each}D)),
                'sum', a.sum + exp(a.log)),
            a -> a.sum)"""
    )
    certified = cells_df.where(f"good > 0 AND wrong < {each}D * good").withColumn("p", tail)
    certified = certified.where(F.col("p") <= F.lit(delta) / (F.col("strata") * len(RULES) * len(CUTOFFS)))
    gain = F.col("right") / F.greatest(F.col("poor"), F.lit(1)) - F.lit(10.0) * F.col("wrong") / F.col("good")
    best = certified.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b"))
    return best.select("stratum", "rule", F.col("b.cutoff").alias("cutoff"))


def with_verdict(feats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``base_failed`` and ``kept``.

    The cutoffs become one row for each stratum.  There are at most as many
    as languages; the table is left to the planner, which broadcasts it only
    below its own size limit.
    """
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES))
    joined = feats.join(wide, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_ratio(rule) > F.col(f"_cut_{rule}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rejected))


def judge(documents: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features, ``base_failed`` and ``kept`` for every row of ``documents``, beside the columns in ``keep``.

    Features are computed once and written to the shared folder (a few numbers
    for each document); texts cross no shuffle.
    """
    feats = materialize(features(documents, keep=("doc_id", "lang", *keep)), "quality-features")
    cutoffs = materialize(learn(feats, labels, alpha, delta), "quality-cutoffs")
    return with_verdict(feats, cutoffs)


def learn(feats: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Cutoffs from the labelled rows of ``feats``."""
    return thresholds(feats.join(_verdicts(labels), "doc_id"), alpha=alpha, delta=delta)


def _verdicts(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))


def keep_good(documents: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``documents`` that neither a base rule nor a certified cutoff rejects, with all their columns.

    Cutoffs are learned from the labelled rows alone; then every row is judged
    by itself, whatever its id, and its text crosses no shuffle.  Labels are
    broadcast below a counted size (two narrow columns).
    """
    verdicts = materialize(_verdicts(labels), "quality-verdicts")
    labelled = documents.select("doc_id", "text", "lang").join(hint(verdicts, verdicts.count()), "doc_id")
    learned = materialize(features(labelled, keep=("doc_id", "lang", "bad")), "quality-labelled")
    cutoffs = materialize(thresholds(learned, alpha=alpha, delta=delta), "quality-cutoffs")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"), "text", F.col("lang").alias("_lang"))
    return with_verdict(_settled(features(rows, keep=("_row", "_lang")), "_row", "_lang"), cutoffs, "_lang").where("kept").select("_row.*")


def _settled(feats: DataFrame, *keep: str) -> DataFrame:
    """``feats`` computed before anything that is asked of them: else the planner writes every feature out wherever it is used."""
    return feats.select(*keep, F.inline(F.array(F.struct(*(c for c in feats.columns if c not in keep)))))
