"""Counters of pages and scans, and the panel's own analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_rating(c: Column) -> Column:
    """Whether a rating is a whole number from 1 to 5."""
    return F.coalesce((c == F.floor(c)) & c.between(1, 5), F.lit(False))


def extraction_rows(rows: DataFrame) -> DataFrame:
    """Adds ``eligible`` and ``missing`` to reviews with ``text, rating, urls``."""
    blank, image = F.coalesce("text", F.lit("")) == "", F.size("urls") > 0
    missing = F.array_compact(F.array(F.when(blank, "text"), F.when(F.col("rating").isNull(), "rating"), F.when(~image, "image")))
    return rows.withColumns({"eligible": ~blank & valid_rating(F.col("rating")), "missing": missing, "has_image": image})


def accepted(rows: DataFrame, page: str, most: int = 20) -> DataFrame:
    """Reviews of each page that count: with anything to show, each text once in any case, the first ``most`` by ``pos``."""
    shown = extraction_rows(rows).where((F.col("text") != "") | F.col("rating").isNotNull() | F.col("has_image"))
    again = F.when(F.col("text") == "", 1).otherwise(F.row_number().over(Window.partitionBy(page, F.sha2(F.lower("text"), 256)).orderBy("pos")))
    place = F.sum(F.when(F.col("again") == 1, 1).otherwise(0)).over(Window.partitionBy(page).orderBy("pos", "review_id").rowsBetween(Window.unboundedPreceding, 0))
    return shown.withColumn("again", again).withColumn("place", place).withColumn("accepted", (F.col("again") == 1) & (F.col("place") <= most))


def extraction_stats(rows: DataFrame, page: str, most: int = 20) -> DataFrame:
    """Counters of each page: candidates, accepted and analysable reviews, duplicates, and what they have."""
    a, ok = accepted(rows, page, most), F.col("accepted")
    seen = a.groupBy(page).agg(
        F.count_if(ok).alias("accepted"), F.count_if(ok & F.col("eligible")).alias("analyzable"), F.count_if(F.col("again") > 1).alias("duplicates"), F.count_if(F.col("text") == "").alias("without_text"),
        F.count_if(ok & F.col("has_image")).alias("with_images"), F.count_if(ok & F.col("rating").isNotNull()).alias("with_ratings"),
    )
    return rows.groupBy(page).agg(F.count("*").alias("candidates")).join(seen, page, "left").na.fill(0)


def scan_coverage(rows: DataFrame, page: str) -> DataFrame:
    """Loaded, analysed and skipped reviews of each page, and why they were skipped."""
    text, rating = F.trim(F.coalesce("text", F.lit(""))) != "", valid_rating(F.col("rating"))
    own = text & rating
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(page).agg(F.count("*").alias("loaded"), n(own, "analyzed"), n(~own, "skipped"), n(~own & ~text, "missing_text"), n(~own & ~rating, "missing_rating"), n(text, "with_text"), n(rating, "with_rating"), n(F.size("urls") > 0, "with_photos"))


def local_analysis(classified: DataFrame, hits: DataFrame, page: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The panel's own analysis of each page: one row of counts, and its ``most`` mentioned topics.

    ``classified``: page, review_id, label, sentiment, rating; ``hits``: review_id, topic, place (order of topics).
    """
    own, seen = F.col("label") == "authentic", F.col("label") != "unavailable"
    n = lambda c, name: F.count_if(c).alias(name)
    half_up = lambda a, b: F.when(b == 0, 0).otherwise(F.floor(a / b * 100 + 0.5)).cast("int")
    head = classified.groupBy(page).agg(
        *[n(F.col("label") == c, c) for c in ("authentic", "liv", "irrelevant", "deceptive")], *[n(own & (F.col("sentiment") == s), s) for s in ("positive", "neutral", "negative")],
        half_up(F.count_if(own), F.count_if(seen)).alias("authentic_share"), F.round(F.avg(F.when(own, F.col("rating"))), 9).alias("verified_rating"),
    )
    topics = hits.join(classified.where(own).select("review_id", page, "sentiment"), "review_id").groupBy(page, "topic", "place").agg(F.count("*").alias("mentions"), half_up(F.count_if(F.col("sentiment") == "positive"), F.count("*")).alias("positive_percent"))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("mentions"), "place"))
    return head, topics.withColumn("rank", rank).where(F.col("rank") <= most).select(page, "rank", "topic", "mentions", "positive_percent")
