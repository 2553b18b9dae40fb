"""Paired errors of product-aspect sentiment with and without the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.contract import aspects


def _scores(reviews: DataFrame, pairs: DataFrame, name: str, gate: str | None) -> DataFrame:
    """Mean over reviews of the mean of their distinct polarities, by product and aspect."""
    kept = reviews.where(f"{gate} = 0") if gate else reviews
    value = pairs.select("review_id", "aspect", "sentiment").distinct().groupBy("review_id", "aspect").agg(F.avg(F.col("sentiment") - 1).alias("v"))
    return value.join(kept.select("review_id", "product_id"), "review_id").groupBy("product_id", "aspect").agg(F.avg("v").alias(name))


def aspect_pairs(reviews: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth, gated and ungated score, their errors and what is missing, for every product and aspect.

    ``reviews``: review_id, product_id, truth, pred. Nulls stay null; a pair is eligible if all three are known.
    """
    grid = reviews.select("product_id").distinct().crossJoin(aspects(reviews.sparkSession).select("aspect"))
    out = grid
    for part in (_scores(reviews, gold, "truth_score", "truth"), _scores(reviews, predicted, "filtered", "pred"), _scores(reviews, predicted, "unfiltered", None)):
        out = out.join(part, ["product_id", "aspect"], "left")
    fe, ue = F.abs(F.col("filtered") - F.col("truth_score")), F.abs(F.col("unfiltered") - F.col("truth_score"))
    ok = F.col("truth_score").isNotNull() & F.col("filtered").isNotNull() & F.col("unfiltered").isNotNull()
    reasons = F.array_compact(F.array(*[F.when(F.col(c).isNull(), r) for c, r in (("truth_score", "no_ground_truth"), ("filtered", "no_filtered_prediction"), ("unfiltered", "no_unfiltered_prediction"))]))
    return out.select(
        "product_id", "aspect", *[F.round(c, 9).alias(c) for c in ("truth_score", "filtered", "unfiltered")], F.round(fe, 9).alias("filtered_error"), F.round(ue, 9).alias("unfiltered_error"), ok.alias("eligible"), F.when(ok, F.round(ue - fe, 9)).alias("improvement"), F.array_join(reasons, ",").alias("reasons")
    )


def by_aspect(pairs: DataFrame) -> DataFrame:
    """Counts of pairs and mean errors of the eligible ones, by aspect."""
    own, truth = F.col("eligible"), F.col("truth_score").isNotNull()
    n = lambda c, name: F.sum(c.cast("int")).cast("bigint").alias(name)
    mean = lambda c: F.round(F.avg(F.when(own, F.col(c))), 6)
    return pairs.groupBy("aspect").agg(
        n(own, "eligible_pairs"), n(truth, "with_truth"), n(truth & F.col("filtered").isNull(), "missing_filtered"), n(truth & F.col("unfiltered").isNull(), "missing_unfiltered"), n(~truth & F.col("filtered").isNotNull(), "filtered_without_truth"),
        n(own & (F.col("improvement") > 0), "improved"), n(own & (F.col("improvement") < 0), "worsened"), mean("filtered_error").alias("filtered_mae"), mean("unfiltered_error").alias("unfiltered_mae"),
    )


def counts(pairs: DataFrame) -> DataFrame:
    """By aspect: products, and of these those with a truth, paired, excluded, or missing a side; and the mean improvement."""
    t, f, u = (F.col(c).isNotNull() for c in ("truth_score", "filtered", "unfiltered"))
    own = F.col("eligible")
    n = lambda c, name: F.count_if(c).alias(name)
    return pairs.groupBy("aspect").agg(
        F.count("*").alias("products"), n(t, "with_truth"), n(own, "paired"), n(t & ~own, "excluded"), n(~t, "without_truth"), n(t & ~f, "missing_filtered"), n(t & ~u, "missing_unfiltered"), n(~t & f, "filtered_without_truth"), n(~t & u, "unfiltered_without_truth"),
        F.round(F.avg(F.when(own, F.col("improvement"))), 6).alias("improvement"),
    )


def overall(pairs: DataFrame) -> DataFrame:
    """Pooled means over eligible pairs and means over the aspects that have any."""
    own = F.col("eligible")
    pooled = pairs.agg(F.sum(own.cast("int")).cast("bigint").alias("eligible_pairs"), *[F.round(F.avg(F.when(own, F.col(f"{c}_error"))), 6).alias(f"pooled_{c}") for c in ("filtered", "unfiltered")])
    macro = by_aspect(pairs).where("eligible_pairs > 0").agg(*[F.round(F.avg(f"{c}_mae"), 5).alias(f"macro_{c}") for c in ("filtered", "unfiltered")])
    return pooled.crossJoin(macro)


def pooled_by_product(reviews: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Errors of the mean over all pairs of a product, whatever the aspect."""
    def mean(pairs: DataFrame, name: str, gate: str | None) -> DataFrame:
        kept = reviews.where(f"{gate} = 0") if gate else reviews
        return pairs.join(kept.select("review_id", "product_id"), "review_id").groupBy("product_id").agg(F.avg(F.col("sentiment") - 1).alias(name))

    out = reviews.select("product_id").distinct()
    for part in (mean(gold, "truth_score", "truth"), mean(predicted, "filtered", "pred"), mean(predicted, "unfiltered", None)):
        out = out.join(part, "product_id", "left")
    return out.select("product_id", *[F.round(c, 9).alias(c) for c in ("truth_score", "filtered", "unfiltered")], *[F.round(F.abs(F.col(c) - F.col("truth_score")), 9).alias(f"{c}_error") for c in ("filtered", "unfiltered")])
