"""Multiclass and multilabel metrics over fixed label lists, and threshold searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: tuple[str, ...] = (), k: int = 4) -> DataFrame:
    """Counts of every (actual, pred) of ``k`` labels, with zeros, for each value of ``by``."""
    spark = df.sparkSession
    grid = spark.range(k).select(F.col("id").cast("int").alias("actual")).crossJoin(spark.range(k).select(F.col("id").cast("int").alias("pred")))
    n = df.groupBy(*by, "actual", "pred").agg(F.count("*").alias("n"))
    full = n.select(*by).distinct().crossJoin(F.broadcast(grid)) if by else grid
    return full.join(n, [*by, "actual", "pred"], "left").select(*by, "actual", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_metrics(df: DataFrame, by: tuple[str, ...] = (), k: int = 4) -> DataFrame:
    """Precision, recall, F1 and support of each label of the fixed list (0 where undefined)."""
    m = confusion(df, by, k)
    flat = m.select(*by, F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("is_actual"), F.lit(0).alias("is_pred")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("is_actual"), F.lit(1).alias("is_pred")))).alias("x"), (F.col("actual") == F.col("pred")).alias("hit"), "n")
    s = flat.groupBy(*by, F.col("x.label").alias("label")).agg(
        F.sum(F.col("x.is_actual") * F.col("n")).alias("support"),
        F.sum(F.col("x.is_pred") * F.col("n")).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("x.is_actual") * F.col("n")).otherwise(0)).alias("tp"),
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return s.select(*by, "label", "support", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(ratio(2 * p * r, p + r), 9).alias("f1"))


def macro(df: DataFrame, by: tuple[str, ...] = (), k: int = 4) -> DataFrame:
    """Accuracy and plain means over the fixed label list."""
    some = F.sum("support") > 0  # of no rows there are no means
    m = class_metrics(df, by, k).groupBy(*by).agg(*[F.when(some, F.round(F.avg(c), 6)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    a = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("actual") == F.col("pred")).cast("int")), 9).alias("accuracy"))
    return a.join(m, list(by)) if by else a.crossJoin(m)


def multilabel(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TP, FP, FN, TN, precision, recall and F1 of each label of rows ``id, label, truth, pred`` (0 or 1)."""
    t, p = F.col("truth") == 1, F.col("pred") == 1
    n = lambda c, name: F.sum(c.cast("int")).cast("bigint").alias(name)
    s = df.groupBy(*by, "label").agg(n(t & p, "tp"), n(~t & p, "fp"), n(t & ~p, "fn"), n(~t & ~p, "tn"))
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return s.select(*by, "label", "tp", "fp", "fn", "tn", F.round(prec, 9).alias("precision"), F.round(rec, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def multilabel_report(df: DataFrame, by: str) -> DataFrame:
    """Counts and F1 of each label over all rows (``by`` null) and for each ``by``, in one pass over ``id, label, truth, pred``."""
    t, p = F.col("truth") == 1, F.col("pred") == 1
    n = lambda c, name: F.count_if(c).alias(name)
    s = df.groupingSets([[F.col("label")], [F.col(by), F.col("label")]], F.col(by), F.col("label")).agg(n(t & p, "tp"), n(~t & p, "fp"), n(t & ~p, "fn"))
    return s.withColumn("f1", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9))


def multilabel_summary(df: DataFrame) -> DataFrame:
    """Macro means, micro F1 and the share of rows with all labels right."""
    per = multilabel(df)
    tp, rest = F.sum("tp"), F.sum(F.col("fp") + F.col("fn"))
    m = per.agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.round(ratio(2 * tp, 2 * tp + rest), 9).alias("micro_f1"))
    exact = df.groupBy("id").agg(F.min((F.col("truth") == F.col("pred")).cast("int")).alias("ok")).agg(F.count("*").alias("n"), F.round(F.avg("ok"), 9).alias("exact_accuracy"))
    return m.crossJoin(exact)


def threshold_counts(df: DataFrame, candidates: list[float], fallback: str | None = None) -> DataFrame:
    """``threshold, label, tp, fp, fn`` of rows ``label, truth, p`` for every candidate, from one aggregation.

    Rows are counted by label and cell, the number of candidates that ``p`` reaches; a candidate's counts are those of the cells
    from its own on. With ``fallback`` (the column that names an instance) the first greatest label of an instance
    counts as reaching every candidate: it does up to its own chance, and beyond that no other does.
    """
    steps = sorted(set(map(float, candidates)))
    cell = sum(((F.col("p") >= c).cast("int") for c in steps), F.lit(0))
    if fallback:
        best = F.max(F.struct("p", (-F.col("label")).alias("back"))).over(Window.partitionBy(fallback))
        df = df.withColumn("best", best)
        cell = F.when(F.col("label") == -F.col("best.back"), F.lit(len(steps))).otherwise(cell)
    counts = df.groupBy("label", F.coalesce(cell, F.lit(0)).alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("hits"))
    each = counts.select("label", "cell", "n", "hits", F.posexplode(F.array(*map(F.lit, steps))).alias("i", "threshold"))
    picked = F.col("cell") > F.col("i")
    some = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("bigint")
    return each.groupBy("threshold", "label").agg(some(picked, F.col("hits")).alias("tp"), some(picked, F.col("n") - F.col("hits")).alias("fp"), some(~picked, F.col("hits")).alias("fn"))


def threshold_search(df: DataFrame, candidates: list[float], fallback: str | None = None) -> DataFrame:
    """The candidate with the best macro F1 over labels of ``label, truth, p``; ties to the nearest of 0.5, then the least.

    With ``fallback`` (the column that names an instance), one none of whose chances reaches the candidate
    takes its first greatest label.
    """
    f1 = F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9)
    f = threshold_counts(df, candidates, fallback).groupBy("threshold").agg(F.round(F.avg(f1), 6).alias("macro_f1"))
    return f.orderBy(F.desc("macro_f1"), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold").limit(1)


def joint_thresholds(detection: DataFrame, sentiment: DataFrame, detection_candidates: list[float], sentiment_candidates: list[float], instance: str) -> DataFrame:
    """One row: the threshold of polarities, chosen over the instances of gold aspects, and then that of aspect detection, with their macro F1."""
    s = threshold_search(sentiment, sentiment_candidates, fallback=instance).select(F.col("threshold").alias("sentiment_threshold"), F.col("macro_f1").alias("sentiment_f1"))
    d = threshold_search(detection, detection_candidates).select(F.col("threshold").alias("detection_threshold"), F.col("macro_f1").alias("detection_f1"))
    return s.crossJoin(d)  # one row with one
