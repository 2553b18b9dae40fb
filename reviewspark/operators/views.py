"""What a reader of reviews asks for: search, order, pages, new ones, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.operators.ordering import numbered

#: Rows that one task may sort for a page.
TOP = 10_000
ORDERS = {
    "original": ["pos"],
    "lowest": ["invalid", "star_rating", "pos"],
    "highest": ["invalid", "down", "pos"],
    "longest": ["shorter", "pos"],
}


def search(reviews: DataFrame, query: str, label: int | None = None) -> DataFrame:
    """Reviews with the label (all if none) whose text holds the query, in any case."""
    hit = F.contains(F.lower("review_text"), F.lit(query.lower()))
    return reviews.where(hit if label is None else hit & (F.col("label") == label))


def keyed(reviews: DataFrame, order: str, pos: str = "doc_id") -> DataFrame:
    """Reviews with the columns that ``ORDERS`` sorts by; reviews that tie in all of them come by their ids."""
    return reviews.withColumns({"pos": F.col(pos), "invalid": ~F.coalesce(F.col("star_rating").between(1, 5), F.lit(False)), "down": -F.col("star_rating"), "shorter": -F.length("review_text")})


def ordered(reviews: DataFrame, order: str, pos: str = "doc_id") -> DataFrame:
    """Reviews in an order of ``ORDERS``: invalid ratings last, then as they stood."""
    rows = keyed(reviews, order, pos).orderBy(*ORDERS[order])
    return rows.drop("pos", "invalid", "down", "shorter") if pos == "doc_id" else rows


def page(reviews: DataFrame, order: str, number: int, size: int = 20) -> DataFrame:
    """One page, with the place of each review in the whole order.

    The first pages are the top rows of the order; a deep one is cut out of places that are counted over ranges, so that no task sorts all rows before it.
    """
    rows = keyed(reviews, order)
    if (number + 1) * size <= TOP:
        top = rows.orderBy(*ORDERS[order]).limit((number + 1) * size)
        placed = top.withColumn("place", F.row_number().over(Window.orderBy(*ORDERS[order])))
    else:
        placed = numbered(rows, [], ORDERS[order], "at").withColumn("place", (F.col("at") + 1).cast("int"))
    return placed.where((F.col("place") > number * size) & (F.col("place") <= (number + 1) * size)).select(*reviews.columns, "place")


def top_evidence(pairs: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` reviews of each aspect."""
    r = F.row_number().over(Window.partitionBy("aspect").orderBy("review_id", "sentiment"))
    return pairs.withColumn("r", r).where(F.col("r") <= n)


def additional(now: DataFrame, before: DataFrame) -> DataFrame:
    """Reviews of this scan that the one before didn't have."""
    return now.join(before.select("review_id"), "review_id", "left_anti")


def coverage(reviews: DataFrame) -> DataFrame:
    """Reviews loaded and eligible, and those without text or a valid rating."""
    text, rating = F.trim(F.coalesce("review_text", F.lit(""))) != "", F.coalesce(F.col("star_rating").between(1, 5), F.lit(False))
    return reviews.agg(F.count("*").alias("loaded"), F.count_if(text & rating).alias("eligible"), F.count_if(~text).alias("missing_text"), F.count_if(~rating).alias("missing_rating"))


def first_seen(reviews: DataFrame, key: str = "k", pos: str = "doc_id") -> DataFrame:
    """The first review of each text, and how many there are."""
    return reviews.groupBy(key).agg(F.min(pos).alias("first"), F.count("*").alias("n"))


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows in an order, with their places."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
