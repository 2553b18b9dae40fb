"""The piece of a review that speaks best for each aspect and polarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.functions.contract import sentiment_selected


def select_evidence(found: DataFrame, segments: DataFrame, threshold: float, sentiment_threshold: float) -> DataFrame:
    """One segment for each aspect and polarity of a review.

    ``found``: review_id, aspect, score, p (chances of three polarities) of whole reviews; ``segments``:
    review_id, aspect, pos, text, score, p of their pieces. An aspect counts from ``threshold`` up. Its
    candidates are the pieces from the threshold up, else the best one, in order of score, then place.
    For each polarity that the whole review selects, candidates that select it too come first, then the
    greater chance of it, then the greater score, then the order of candidates.
    """
    own = found.where(F.col("score") >= threshold).select("review_id", "aspect", F.col("score").alias("confidence"), F.col("p").alias("whole"))
    ranked = segments.join(own, ["review_id", "aspect"]).withColumn("rank", F.row_number().over(Window.partitionBy("review_id", "aspect").orderBy(F.desc("score"), "pos")))
    candidates = ranked.where((F.col("score") >= threshold) | (F.col("rank") == 1))
    each = candidates.withColumn("sentiment", F.explode(sentiment_selected(F.col("whole"), sentiment_threshold)))
    each = each.withColumns({"agrees": F.array_contains(sentiment_selected(F.col("p"), sentiment_threshold), F.col("sentiment")), "chance": F.col("p")[F.col("sentiment")]})
    best = Window.partitionBy("review_id", "aspect", "sentiment").orderBy(F.desc("agrees"), F.desc("chance"), F.desc("score"), "rank")
    top = each.withColumn("r", F.row_number().over(best)).where("r = 1")
    return top.select("review_id", "aspect", "sentiment", "pos", "text", F.bround("confidence", 4).alias("aspect_confidence"), F.bround(F.col("whole")[F.col("sentiment")], 4).alias("sentiment_confidence"))
