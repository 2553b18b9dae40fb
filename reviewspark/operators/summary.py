"""Product, aspect and overall summaries of classified reviews and their aspect pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.contract import aspects, classes


def product_sentiment(reviews: DataFrame, pairs: DataFrame, gated: bool = True) -> DataFrame:
    """Mean of -1, 0, 1 over the pairs of each product (null without any) and the number of all its reviews.

    ``reviews``: review_id, product_id, label; ``pairs``: review_id, aspect, sentiment. With ``gated`` only
    pairs of authentic reviews count; other reviews are still counted.
    """
    values = pairs.groupBy("review_id").agg(F.count("*").alias("n"), F.sum(F.col("sentiment") - 1).alias("s"))
    counted = F.col("label") == 0 if gated else F.lit(True)
    n, s = F.sum(F.when(counted, F.col("n"))), F.sum(F.when(counted, F.col("s")))
    return reviews.join(values, "review_id", "left").groupBy("product_id").agg(F.count("*").alias("review_count"), F.coalesce(n, F.lit(0)).alias("aspect_count"), F.round(s / n, 9).alias("sentiment"))


def aspect_rollup(reviews: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mentions and share of positive ones by aspect over authentic reviews; absent aspects are left out."""
    hit = pairs.join(reviews.where("label = 0").select("review_id"), "review_id", "left_semi")
    out = hit.groupBy("aspect").agg(F.count("*").alias("mentions"), F.bround(100 * F.sum((F.col("sentiment") == 2).cast("int")) / F.count("*"), 2).alias("positive_percent"))
    return out.join(aspects(reviews.sparkSession), "aspect").select("aspect", "category", "mentions", "positive_percent")


def quality_counts(reviews: DataFrame) -> DataFrame:
    """Reviews by class, with zeros."""
    n = reviews.groupBy("label").agg(F.count("*").alias("n"))
    return classes(reviews.sparkSession).join(n, "label", "left").select("label", "class", F.coalesce("n", F.lit(0)).alias("n"))


def overall(reviews: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: reviews, share of authentic ones, their mean star, and their mean sentiment."""
    own = F.col("label") == 0
    head = reviews.agg(
        F.count("*").alias("review_count"),
        F.coalesce(F.round(100 * F.sum(own.cast("int")) / F.count("*"), 9), F.lit(0.0)).alias("authentic_share"),
        F.round(F.avg(F.when(own, F.col("star_rating"))), 9).alias("verified_rating"),
    )
    mood = pairs.join(reviews.where(own).select("review_id"), "review_id", "left_semi").agg(F.round(F.avg(F.col("sentiment") - 1), 9).alias("sentiment"), F.count("*").alias("aspect_count"))
    return head.join(F.broadcast(mood))
