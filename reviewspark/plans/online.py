"""Requests of reviews analysed in one plan: classes, gate, aspects, summary, and checks of a response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.contract import ASPECTS, CLASSES, POLARITIES, argmax, normalize_rating

Step = Callable[[DataFrame], DataFrame]


def frame(requests: DataFrame) -> DataFrame:
    """One row a review of parsed requests (``request`` as ``read_requests`` gives it); the address stands for the product."""
    r = requests.select("request_id", "request", F.posexplode("request.reviews").alias("pos", "review"))
    return r.select(
        "request_id", "pos", F.col("review.id").alias("review_id"), F.coalesce("request.url", F.lit("")).alias("product_id"), F.col("request.productTitle").alias("product_title"),
        F.coalesce("request.productDescription", F.lit("")).alias("product_description"), F.col("review.text").alias("review_text"), F.col("review.rating").alias("star_rating"), F.coalesce("review.imageUrls", F.array().cast("array<string>")).alias("image_urls"),
    )


def review_rows(reviews: DataFrame, classify: Step) -> DataFrame:
    """Reviews with label, rounded confidence and chances, signals and the six features.

    ``classify`` adds ``probabilities`` (four chances), ``similarity`` and ``best_image`` (null without
    a usable one), and optionally ``label``; else the first greatest chance decides.
    """
    c = classify(reviews)
    label = F.col("label") if "label" in c.columns else argmax(F.col("probabilities"))
    return c.withColumns(
        {
            "label": label,
            "class": F.element_at(F.array(*map(F.lit, CLASSES)), label + 1),
            "confidence": F.bround(F.array_max("probabilities"), 4),
            "chances": F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.transform("probabilities", lambda p: F.bround(p, 4))),
            "features": F.concat("probabilities", F.array(F.coalesce("similarity", F.lit(0.0)), normalize_rating(F.col("star_rating")))),
            "signals": F.array(F.lit("Product and review text"), F.when(F.col("best_image").isNull(), "No usable buyer image; similarity is 0").otherwise("Matched buyer-image similarity"), F.lit("Normalized star rating")),
        }
    )


def summary(rows: DataFrame, pairs: DataFrame, by: str = "request_id") -> DataFrame:
    """For each request: counts of all classes and polarities (zeros too), share, star and sentiment of authentic reviews, and aspects in report order.

    ``rows``: by, review_id, label, star_rating; ``pairs``: review_id, aspect, sentiment. Means of
    nothing are null, the share of nothing is 0.
    """
    own = F.col("label") == 0
    head = rows.groupBy(by).agg(
        F.count("*").alias("review_count"), *[F.count_if(F.col("label") == i).alias(c) for i, c in enumerate(CLASSES)],
        F.coalesce(F.round(100 * F.count_if(own) / F.count("*"), 9), F.lit(0.0)).alias("authentic_share"), F.round(F.avg(F.when(own, F.col("star_rating"))), 9).alias("verified_rating"),
    )
    gated = pairs.join(rows.where(own).select(by, "review_id"), "review_id")
    per = gated.groupBy(by, "aspect").agg(F.count("*").alias("n"), *[F.count_if(F.col("sentiment") == i).alias(p) for i, p in enumerate(POLARITIES)])
    entry = F.struct("aspect", F.concat_ws(":", F.element_at(F.array(*map(F.lit, ASPECTS)), F.col("aspect") + 1), F.col("n").cast("string"), F.bround(100 * F.col("Positive") / F.col("n"), 2).cast("decimal(5,2)").cast("string")).alias("text"))
    mood = per.groupBy(by).agg(*[F.sum(p).alias(p.lower()) for p in POLARITIES], F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), "|").alias("aspects"))
    n = F.col("negative") + F.col("neutral") + F.col("positive")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return head.join(mood, by, "left").select(*head.columns, *[zero(p.lower()) for p in POLARITIES], F.coalesce("aspects", F.lit("")).alias("aspects"), F.round((F.col("positive") - F.col("negative")) / n, 9).alias("sentiment"))


def run(reviews: DataFrame, classify: Step, find_aspects: Step, by: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Rows and summaries of all requests; ``find_aspects`` only ever sees reviews classified as authentic."""
    rows = review_rows(reviews, classify)
    return rows, summary(rows, find_aspects(rows.where("label = 0")), by)


def response_json(rows: DataFrame, summaries: DataFrame, by: str = "request_id") -> DataFrame:
    """One JSON document a request (at most 20 reviews each, so that a request fits a row)."""
    each = rows.groupBy(by).agg(F.collect_list(F.struct("pos", "review_id", F.col("class").alias("label"), "confidence", "chances", "signals")).alias("reviews"))
    each = each.withColumn("reviews", F.array_sort("reviews", lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)))
    return summaries.join(each, by).select(by, F.to_json(F.struct(*[c for c in summaries.columns if c != by], "reviews")).alias("response"))


def response_problems(payload: DataFrame, answered: DataFrame, counts: DataFrame, by: str = "request_id") -> DataFrame:
    """For each request, what is wrong with a response.

    ``payload``: by, review_id, eligible; ``answered``: by, review_id, label (a name or alias); ``counts``:
    by, the four classes, authentic_share. Ids must be those of eligible reviews, once each; labels
    must be known; counts and share (within 0.51) must be those of the answers.
    """
    # Names of labels in responses.
    names = {**{c: c for c in CLASSES}, "low-value": "liv", "low_value": "liv"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower("label"))
    a = answered.groupBy(by, "review_id").agg(F.count("*").alias("times"), F.max(name).alias("class"), F.count_if(name.isNull()).alias("unknown"))
    j = payload.where("eligible").select(by, "review_id", F.lit(True).alias("asked")).join(a, [by, "review_id"], "full")
    seen = j.groupBy(by).agg(
        F.count_if(F.col("times") > 1).alias("duplicate"), F.count_if(F.col("asked").isNull()).alias("unexpected"), F.count_if(F.col("times").isNull()).alias("missing"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_label"),
        *[F.count_if(F.col("asked") & (F.col("class") == c)).alias(f"_{c}") for c in CLASSES], F.count_if("asked").alias("_n"),
    )
    share = F.when(F.col("_n") > 0, 100 * F.col("_authentic") / F.col("_n")).otherwise(0.0)
    wrong = sum((F.coalesce(F.col(c) != F.col(f"_{c}"), F.lit(True)).cast("int") for c in CLASSES), F.lit(0))
    out = seen.join(counts, by, "left")
    return out.select(by, "duplicate", "unexpected", "missing", "unknown_label", wrong.alias("counts_off"), F.coalesce(F.abs(F.col("authentic_share") - share) > 0.51, F.lit(True)).alias("share_off"))


def merged_view(payload: DataFrame, answered: DataFrame, by: str = "request_id") -> DataFrame:
    """All reviews that were loaded, with the label of the response, or ``unavailable`` and what is missing."""
    missing = F.array_join(F.array_compact(F.array(F.when(F.trim(F.coalesce("review_text", F.lit(""))) == "", "text"), F.when(~F.coalesce(F.col("star_rating").between(1, 5), F.lit(False)), "rating"))), ", ")
    j = payload.join(answered.select(by, "review_id", F.col("label").alias("answer")), [by, "review_id"], "left")
    return j.select(by, "review_id", F.when(F.col("eligible"), F.col("answer")).otherwise("unavailable").alias("label"), F.when(F.col("eligible"), "").otherwise(missing).alias("missing"))
