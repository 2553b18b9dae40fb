"""Row weights for training with augmented families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Group sizes joined back: aggregated first, so that a large group costs a row a task."""
    return df.join(df.groupBy(*by).agg(F.count("*").alias(name)), by)


def row_balanced(df: DataFrame) -> DataFrame:
    """n / (classes present * rows of the class)."""
    total = df.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"))
    return _with(df, ["label"], "c").crossJoin(F.broadcast(total)).select("id", F.round(F.col("n") / (F.col("k") * F.col("c")), 9).alias("weight"))


def source_balanced(df: DataFrame) -> DataFrame:
    """n / (families * rows of the family): every family weighs the same."""
    total = df.agg(F.count("*").alias("n"), F.count_distinct("family").alias("k"))
    return _with(df, ["family"], "c").crossJoin(F.broadcast(total)).select("id", F.round(F.col("n") / (F.col("k") * F.col("c")), 9).alias("weight"))


def source_class_balanced(df: DataFrame) -> DataFrame:
    """n / (4 * families of the class * rows of the family): every class weighs the same, and in it every family."""
    total = df.agg(F.count("*").alias("n"))
    per = df.groupBy("label").agg(F.count_distinct("family").alias("k"))
    return _with(df, ["family"], "c").join(F.broadcast(per), "label").crossJoin(F.broadcast(total)).select("id", F.round(F.col("n") / (4 * F.col("k") * F.col("c")), 9).alias("weight"))


def family_violations(rows: DataFrame) -> DataFrame:
    """One row: families whose rows differ in label or product, and families without their original (``family, label, product, original``)."""
    f = rows.groupBy("family").agg(F.count_distinct("label").alias("l"), F.count_distinct("product").alias("p"), F.max("original").alias("own"))
    return f.agg(F.count_if(F.col("l") > 1).alias("labels_differ"), F.count_if(F.col("p") > 1).alias("products_differ"), F.count_if(~F.coalesce("own", F.lit(False))).alias("without_original"))
