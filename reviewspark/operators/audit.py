"""Audits: out-of-fold errors by family, provenance, comparisons, fingerprints, feature checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.functions.contract import argmax


def judged(rows: DataFrame, sure: float = 0.8) -> DataFrame:
    """Adds ``prediction``, ``confidence``, ``wrong`` and ``sure_wrong`` to rows with ``probabilities`` and ``label``, and the population and family of each.

    ``source_review_id`` is blank or null for an original, else it names the original of a draft.
    """
    source = F.coalesce(F.col("source_review_id"), F.lit(""))
    out = rows.withColumns({"prediction": argmax(F.col("probabilities")), "confidence": F.array_max("probabilities"), "population": F.when(source == "", "original").otherwise("synthetic"), "family": F.when(source == "", F.col("review_id")).otherwise(source)})
    return out.withColumn("wrong", F.col("prediction") != F.col("label")).withColumn("sure_wrong", F.col("wrong") & (F.col("confidence") >= sure))


def error_summary(rows: DataFrame) -> DataFrame:
    """Rows and errors of all, of each population, and of each fold and population, in one grouping-sets pass."""
    grains = rows.groupingSets([[], [F.col("population")], [F.col("fold"), F.col("population")]], F.col("fold"), F.col("population"))
    return grains.agg(F.count("*").alias("n"), F.count_if("wrong").alias("errors"), F.count_if("sure_wrong").alias("sure_errors"), F.count_if(F.col("label") != F.col("ground_truth")).alias("targets_differ"))


def family_errors(rows: DataFrame) -> DataFrame:
    """Families with drafts: their drafts, rows and errors."""
    draft = F.col("population") == "synthetic"
    return rows.groupBy("family").agg(F.count_if(draft).alias("drafts"), F.count("*").alias("rows"), F.count_if(draft & F.col("wrong")).alias("errors"), F.count_if(draft & F.col("sure_wrong")).alias("sure_errors")).where("drafts > 0")


def concentration(families: DataFrame, top: int = 5) -> DataFrame:
    """One row: drafts in all, families, the largest family, and the share of the ``top`` largest (ties by name)."""
    first = families.orderBy(F.desc("drafts"), "family").limit(top).agg(F.sum("drafts").alias("top"))
    return families.agg(F.coalesce(F.sum("drafts"), F.lit(0)).alias("drafts"), F.count("*").alias("families"), F.coalesce(F.max("drafts"), F.lit(0)).alias("largest")).crossJoin(F.broadcast(first)).select("drafts", "families", "largest", F.round(F.col("top") / F.col("drafts"), 9).alias("top_share"))


def audit_sample(rows: DataFrame, per: int = 3) -> DataFrame:
    """The first sure error of each family and class in a population, then at most ``per`` by population and class."""
    w = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("fold", "review_id"))
    one = rows.where("sure_wrong").withColumn("r", w("population", "label", "family")).where("r = 1")
    return one.withColumn("r", w("population", "label")).where(F.col("r") <= per).select("review_id", "family", "population", "label", "r")


def errors_with_source(rows: DataFrame) -> DataFrame:
    """Wrong rows in the order of reports, each with the product and fold of its family's original."""
    source = rows.where("population = 'original'").select(F.col("review_id").alias("family"), F.col("product_id").alias("source_product"), F.col("fold").alias("source_fold"))
    return rows.where("wrong").join(source, "family", "left").select("population", "fold", "review_id", "family", "source_product", "source_fold", "prediction", F.round("confidence", 9).alias("confidence")).orderBy("population", "fold", "review_id")


def feature_table(reviews: DataFrame, oof: DataFrame, similarity: DataFrame) -> DataFrame:
    """Six features: four chances, the best image similarity (0 without images), the star on 0 to 1."""
    p = [F.col("probabilities")[i].alias(f"dim{i + 1}") for i in range(4)]
    return reviews.join(oof, "review_id").join(similarity, "review_id", "left").select("review_id", "product_id", *p, F.coalesce("best_score", F.lit(0.0)).alias("dim5"), ((F.col("star_rating") - 1) / 4).alias("dim6"))


def feature_distribution(features: DataFrame, by: str) -> DataFrame:
    """Share of rows without image similarity and means, by class."""
    return features.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("dim5") == 0).cast("int")), 9).alias("zero_share"), F.round(F.avg("dim5"), 6).alias("mean_similarity"), F.round(F.avg("dim6"), 9).alias("mean_star"), F.round(F.avg(F.greatest("dim1", "dim2", "dim3", "dim4")), 6).alias("mean_best")
    )


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """One row: a digest of all rows that depends on neither their order nor their partitions.

    Rows (values as text, columns by name) are hashed and hashes added up in four 60-bit lanes, so no
    task holds the table. The key makes rows distinct, so what moves between rows shows.
    """
    row = F.sha2(F.concat_ws("\u001f", F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)]), 256)
    lanes = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *lanes), 256).alias("fingerprint"))


def metric_delta(a: DataFrame, b: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """Candidate less reference of each metric."""
    return a.join(b.select(*on, *[F.col(m).alias(f"_{m}") for m in metrics]), on).select(*on, *[F.round(F.col(m) - F.col(f"_{m}"), 9).alias(f"{m}_delta") for m in metrics])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    cols = sorted(set(a.columns) & set(b.columns))
    x, y = a.select(*cols), b.select(*cols)
    return not x.exceptAll(y).head(1) and not y.exceptAll(x).head(1)


def best_image(rows: DataFrame, key: str = "review_id") -> DataFrame:
    """The first image with the best score of each review: ``best_score, best_pos``."""
    top = F.max(F.struct("score", (-F.col("pos")).alias("back")))
    return rows.groupBy(key).agg(top.alias("t")).select(key, F.col("t.score").alias("best_score"), (-F.col("t.back")).alias("best_pos"))
