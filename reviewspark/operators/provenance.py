"""Provenance: which rows models were fitted on and judged by, against what the split says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_sides(assigned: DataFrame, folds: int = 5) -> DataFrame:
    """``fold, side, review_id, product_id``: of the training rows, those outside each fold (fit) and in it (held)."""
    numbers = F.broadcast(assigned.sparkSession.range(folds).select(F.col("id").cast("int").alias("k")))
    rows = assigned.where("partition = 'train'").crossJoin(numbers)
    return rows.select(F.col("k").alias("fold"), F.when(F.col("fold") == F.col("k"), "held").otherwise("fit").alias("side"), "review_id", "product_id")


def set_differences(stated: DataFrame, expected: DataFrame, by: list[str], item: str) -> DataFrame:
    """For each ``by``: items that only one side has (``missing``: expected alone, ``extra``: stated alone)."""
    both = expected.select(*by, item).distinct().withColumn("e", F.lit(1)).join(stated.select(*by, item).distinct().withColumn("s", F.lit(1)), [*by, item], "full")
    return both.groupBy(*by).agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))


def fold_overlap(sides: DataFrame, item: str = "product_id") -> DataFrame:
    """Items that stand on both sides of a fold, by fold."""
    both = sides.groupBy("fold", item).agg(F.count_distinct("side").alias("k"))
    return both.groupBy("fold").agg(F.count_if(F.col("k") > 1).alias("shared"))


def oof_violations(oof: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows of out-of-fold predictions that break a rule, by rule: coverage, product and fold, source, chances."""
    training = assigned.where("partition = 'train'").select("review_id", F.col("product_id").alias("p"), F.col("fold").alias("f"))
    twice = oof.groupBy("review_id").agg(F.count("*").alias("c"))
    j = oof.join(training, "review_id", "left").join(twice, "review_id")
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0)) | F.coalesce(F.abs(total - 1) > 1e-5, F.lit(True))
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    seen = j.agg(
        is_(F.col("p").isNull()).alias("not_in_training"), is_(F.col("c") > 1).alias("repeated"), is_(F.col("product_id") != F.col("p")).alias("other_product"), is_(F.col("fold") != F.col("f")).alias("other_fold"),
        is_(F.col("probability_source") != F.concat(F.lit("oof_fold_"), F.col("fold").cast("string"))).alias("other_source"), is_(bad).alias("bad_chances"),
    )
    return seen.crossJoin(F.broadcast(training.join(oof, "review_id", "left_anti").agg(F.count("*").alias("not_predicted"))))


def training_oof(assigned: DataFrame, oof: DataFrame) -> DataFrame:
    """Training rows with their out-of-fold chances, one to one on review, product and fold."""
    return assigned.where("partition = 'train'").join(oof.select("review_id", "product_id", "fold", "probabilities"), ["review_id", "product_id", "fold"])


def feature_violations(features: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows of a feature table that break a rule, by rule; test rows have no place in it.

    ``features``: review_id, product_id, partition, fold, ground_truth, probability_source, dim1 to dim6.
    """
    expected = assigned.where("partition <> 'test'").select("review_id", "product_id", "partition", "fold", F.col("truth").alias("t"))
    j = features.join(expected, ["review_id", "product_id", "partition", "fold"], "left")
    dims = [F.col(f"dim{i}") for i in range(1, 7)]
    finite = [~(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))) for d in dims]
    whole = finite[0] & finite[1] & finite[2] & finite[3]
    source = F.when(F.col("partition") == "train", F.concat(F.lit("oof_fold_"), F.col("fold").cast("string"))).otherwise("final_text_model")
    is_ = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    seen = j.agg(
        is_(F.col("t").isNull(), "not_expected"), is_(F.col("ground_truth") != F.col("t"), "label_differs"), is_(F.col("probability_source") != source, "other_source"),
        is_(~(whole & finite[4] & finite[5]), "not_finite"), is_(whole & (F.abs(sum(dims[1:4], dims[0]) - 1) > 1e-5), "chances_not_one"), is_(whole & (F.least(*dims[:4]) < 0), "negative_chance"),
        is_(finite[4] & (F.abs(dims[4]) > 1.00001), "similarity_range"), is_(finite[5] & ~dims[5].between(0, 1), "star_range"),
    )
    return seen.crossJoin(F.broadcast(expected.join(features, "review_id", "left_anti").agg(F.count("*").alias("not_covered"))))


def settings_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``name`` of settings (``name, value``) that two runs don't share, with both values: a run may go on only where there are none."""
    both = a.select("name", F.col("value").alias("a")).join(b.select("name", F.col("value").alias("b")), "name", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def cohorts(assigned: DataFrame) -> DataFrame:
    """``model, side, review_id``: rows that each model of a bundle must have been fitted on and validated by."""
    side = F.when(F.col("partition") == "train", "fit").when(F.col("partition") == "validation", "validation")
    models = F.when(F.col("truth") == 0, F.array(F.lit("text"), F.lit("booster"), F.lit("aspects"))).otherwise(F.array(F.lit("text"), F.lit("booster")))
    return assigned.where("partition <> 'test'").select(F.explode(models).alias("model"), side.alias("side"), "review_id")


def text_overlap(challenge: DataFrame, training: DataFrame, text: str = "review_text") -> DataFrame:
    """Challenge rows whose text, in any case, stands in training too."""
    key = F.sha2(F.lower(text), 256)
    return challenge.withColumn("k", key).join(training.select(key.alias("k")).distinct(), "k", "left_semi").drop("k")
