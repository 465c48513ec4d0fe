"""Column functions for scores, labels and label counts. All built-in expressions; no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from newsmood.constants import (LABEL_EDGE, LABELS, LEXICON, NEGATIVE, NEUTRAL, POSITIVE, RANK_FLOOR,
                                RANK_SHIFT)


def polarity(pos: Column, neg: Column) -> Column:
    return F.tanh(pos - neg)


def label(score: Column, edge: float = LABEL_EDGE) -> Column:
    """Both edges are inclusive; NULL is neutral."""
    return (F.when(score <= F.lit(-edge), NEGATIVE)
            .when(score >= F.lit(edge), POSITIVE)
            .otherwise(NEUTRAL))


def model_label(model: Column, neg: Column, pos: Column, compound: Column, edge: float = LABEL_EDGE) -> Column:
    """The lexicon model is labelled by its compound score, the classifier by its polarity."""
    return label(F.when(model == LEXICON, compound).otherwise(polarity(pos, neg)), edge)


def count_struct(lab: Column) -> Column:
    """One-hot counts of a label. Anything that is neither negative nor positive, NULL too, counts as neutral."""
    negative, positive = lab.eqNullSafe(NEGATIVE), lab.eqNullSafe(POSITIVE)
    return F.struct(
        negative.cast("int").alias("negative"),
        (~negative & ~positive).cast("int").alias("neutral"),
        positive.cast("int").alias("positive"))


def sum_counts(counts: Column, null_policy: str = "propagate") -> Column:
    """Field-wise sum of a counts struct.

    ``propagate``: one NULL element makes every field of that group NULL; ``skip``: NULL elements are left out.
    No rows at all give zeros either way. Plain sums underneath, so Spark aggregates map-side.
    """
    if null_policy not in ("propagate", "skip"):
        raise ValueError(f"null_policy: {null_policy}")

    def field(name: str) -> Column:
        value = counts.getField(name)
        total = F.coalesce(F.sum(value), F.lit(0)).cast("bigint")
        if null_policy == "skip":
            return total.alias(name)
        return F.when(F.count(value) == F.count(F.lit(1)), total).alias(name)

    return F.struct(*[field(name) for name in LABELS])


def tally(lab: Column) -> list[Column]:
    """Aggregates counting each label; same convention as ``count_struct``."""
    one_hot = count_struct(lab)
    return [F.coalesce(F.sum(one_hot.getField(name)), F.lit(0)).cast("bigint").alias(name) for name in LABELS]


def class_compound(neg: Column, neu: Column, pos: Column) -> Column:
    return (pos - neg) / (neu + F.lit(1.0))


def net_score(neg: Column, neu: Column, pos: Column) -> Column:
    """In [-1, 1]; NULL when there is nothing to divide by."""
    lead = pos.cast("double") - neg.cast("double")
    return F.try_divide(lead, neu.cast("double") + F.abs(lead))


def softmax(scores: Column, digits: int = 4) -> Column:
    """Softmax of an array of three class scores, shifted by the maximum so that it cannot overflow."""
    values = [scores[i].cast("double") for i in range(3)]
    exps = [F.exp(v - F.greatest(*values)) for v in values]
    return F.array(*[F.round(e / (exps[0] + exps[1] + exps[2]), digits) for e in exps])


def domain_weight(rank: Column) -> Column:
    return F.lit(1.0) / (F.ln(rank + F.lit(RANK_SHIFT)) + F.lit(1.0)) + F.lit(RANK_FLOOR)


def register_sql_functions(spark: SparkSession) -> None:
    """``senti_count(label)`` and ``senti_label(score)`` for SQL users, as SQL functions (no Python at run time)."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION senti_count(label STRING)
        RETURNS STRUCT<negative INT, neutral INT, positive INT>
        RETURN named_struct(
            'negative', int(label <=> '{NEGATIVE}'),
            'neutral', int(NOT (label <=> '{NEGATIVE}') AND NOT (label <=> '{POSITIVE}')),
            'positive', int(label <=> '{POSITIVE}'))""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION senti_label(score DOUBLE) RETURNS STRING
        RETURN CASE WHEN score <= -{LABEL_EDGE}D THEN '{NEGATIVE}'
                    WHEN score >= {LABEL_EDGE}D THEN '{POSITIVE}' ELSE '{NEUTRAL}' END""")
