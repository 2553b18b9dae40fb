"""Whole runs over files: aspects of a table, predictions of a part, a table through the online plan, cross-fitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions.contract import ASPECTS, POLARITIES, parse_image_urls
from reviewspark.operators import provenance
from reviewspark.plans import online
from reviewspark.sources.reviews import read_reviews, write_json_once

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def named_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reviews with the array of their pairs by name, in report order; those without any have an empty one."""
    each = pairs.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("aspect", "sentiment"))).alias("found"))
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    of = F.transform(F.coalesce("found", F.array().cast("array<struct<aspect:int,sentiment:int>>")), lambda x: F.struct(name(ASPECTS, x["aspect"]).alias("category"), name(POLARITIES, x["sentiment"]).alias("sentiment")))
    return rows.join(each, "review_id", "left").withColumn("aspectSentiment", of).drop("found")


def score_aspects(rows: DataFrame, find_aspects: online.Step, path: str, authentic_only: bool = False) -> None:
    """Write each review with its pairs as JSON. With ``authentic_only`` just those whose ``label`` (or ``label_stage1``) is 0 are scored and written."""
    if authentic_only:
        column = next((c for c in ("label", "label_stage1") if c in rows.columns), None)
        if column is None:
            raise ValueError("label or label_stage1 is needed to keep authentic reviews alone")
        rows = rows.where(F.col(column) == 0)
    write_json_once(named_pairs(rows, find_aspects(rows)), path)


def predict_part(assigned: DataFrame, find_aspects: online.Step, path: str, partition: str) -> None:
    """Write the pairs of one part of the split, or of ``all``, as JSON; a part without reviews raises."""
    rows = assigned if partition == "all" else assigned.where(F.col("partition") == partition)
    if not rows.head(1):
        raise ValueError(f"no review in {partition}")
    write_json_once(named_pairs(rows.select("review_id", "product_id"), find_aspects(rows)), path)


def predict_text(spark: SparkSession, text: str, urls: str, find_aspects: online.Step) -> list[dict[str, str]]:
    """The pairs of one text by name; a blank one raises. ``urls``: addresses of images, as in a table."""
    if not text.strip():
        raise ValueError("the text is blank")
    row = spark.createDataFrame([("manual_review", text.strip(), urls)], "review_id string, review_text string, urls string")
    row = row.select("review_id", "review_text", parse_image_urls(F.col("urls")).alias("image_urls"))
    return [p.asDict() for p in named_pairs(row, find_aspects(row)).first()["aspectSentiment"]]


def run_csv(spark: SparkSession, path: str, classify: online.Step, find_aspects: online.Step) -> tuple[DataFrame, DataFrame]:
    """Rows and one summary of a review CSV through the online plan; rows with problems raise."""
    reviews = read_reviews(spark, path)
    bad = reviews.where(F.size("problems") > 0).first()
    if bad:
        raise ValueError(f"review {bad['review_id']}: {', '.join(bad['problems'])}")
    return online.run(reviews.withColumns({"request_id": F.lit(path), "star_rating": F.col("star_rating").cast("int")}), classify, find_aspects)


def cross_fit(assigned: DataFrame, fit: Fit, folds: int = 5) -> DataFrame:
    """Out-of-fold predictions of all training rows: ``fit`` learns from the other folds and predicts (adds ``probabilities``) the one held out."""
    training, parts = assigned.where("partition = 'train'"), []  # read several times for each fold
    for k in range(folds):
        model = fit(training.where(F.col("fold") != k))
        held = model(training.where(F.col("fold") == k))
        parts.append(held.select("review_id", "product_id", "fold", F.lit(f"oof_fold_{k}").alias("probability_source"), "probabilities"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hashed_words(rows: DataFrame, features: int = 1 << 14) -> DataFrame:
    """``rows`` with ``counts``: how often each hash of a word stands in ``review_text``. It depends on no other row, so that cross-fitting needs it once for all folds."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol="review_text", outputCol="words", pattern=r"\s+").transform(rows)
    return HashingTF(inputCol="words", outputCol="counts", numFeatures=features).transform(words).drop("words")


def text_classifier(target: str, features: int = 1 << 14, rounds: int = 20, weight: str | None = None) -> Fit:
    """A stand-in for a text encoder: hashed words, inverse document frequency, multinomial logistic regression.

    Rows come with their text or, as ``counts``, with their ``hashed_words`` of as many ``features``. Classes that no training row has
    get a chance of 0. ``weight`` names a column of row weights (``operators.weights``). Same interface as an encoder, not its accuracy.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF
    from pyspark.ml.functions import vector_to_array

    counted = lambda df: df if "counts" in df.columns else hashed_words(df, features)

    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        steps = [IDF(inputCol="counts", outputCol="weighted"), LogisticRegression(featuresCol="weighted", labelCol=target, family="multinomial", maxIter=rounds, regParam=0.01, **({"weightCol": weight} if weight else {}))]
        model = Pipeline(stages=steps).fit(counted(rows).withColumn(target, F.col(target).cast("double")))

        def predict(df: DataFrame) -> DataFrame:
            p = vector_to_array(F.col("probability"))
            return model.transform(counted(df)).withColumn("probabilities", F.concat(p, F.array_repeat(F.lit(0.0), F.lit(4) - F.size(p))))

        return predict

    return fit


def checked(oof: DataFrame, assigned: DataFrame) -> DataFrame:
    """The predictions, if they cover all training rows exactly once and break no other rule; else this raises."""
    bad = [k for k, v in provenance.oof_violations(oof, assigned).first().asDict().items() if v]
    if bad:
        raise ValueError(f"predictions break: {', '.join(bad)}")
    return oof
