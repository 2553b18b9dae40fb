"""Reports of balance, of diagnostic cases and of what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.functions.contract import CLASSES, aspects, classes
from reviewspark.operators.digest import ordered_digest

POPULATIONS = ("original", "active", "projected")


def populations(training: DataFrame, drafts: DataFrame) -> DataFrame:
    """Training rows and drafts, each with the populations it counts in: originals in all, approved drafts in two, pending ones if all pass.

    ``training``: review_id, label, text_label, product_id; ``drafts``: review_id, source_review_id, review_status.
    """
    own = training.select("review_id", "review_id", "label", "text_label", "product_id").toDF("review_id", "source_review_id", "label", "text_label", "product_id").withColumn("populations", F.array(*map(F.lit, POPULATIONS)))
    status = F.col("review_status")
    of = F.when(status == "approved", F.array(F.lit("active"), F.lit("projected"))).when(status == "pending", F.array(F.lit("projected")))
    kept = drafts.where(status != "rejected").select(F.col("review_id"), "source_review_id", of.alias("populations"))
    source = training.select(F.col("review_id").alias("source_review_id"), "label", "text_label", "product_id")
    return own.unionByName(kept.join(source, "source_review_id"))


def balance_quality(rows: DataFrame) -> DataFrame:
    """Rows of each class, for both targets and all populations, with zeros."""
    spark = rows.sparkSession
    two = F.array(F.struct(F.lit("ground_truth").alias("target"), F.col("label").alias("k")), F.struct(F.lit("text_label").alias("target"), F.col("text_label").alias("k")))
    n = rows.select(F.explode("populations").alias("population"), two.alias("t")).select("population", F.explode("t").alias("t")).groupBy("population", "t.target", "t.k").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(p, t, k) for p in POPULATIONS for t in ("ground_truth", "text_label") for k in range(4)], "population string, target string, label int")
    return grid.join(n.withColumnRenamed("k", "label"), ["population", "target", "label"], "left").na.fill(0, ["n"])


def balance_folds(training: DataFrame) -> DataFrame:
    """Products of each fold and its rows by class."""
    return training.groupBy("fold").agg(F.count_distinct("product_id").alias("products"), *[F.count_if(F.col("label") == i).alias(c) for i, c in enumerate(CLASSES)])


def balance_aspects(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Authentic reviews that hold each of the 30 aspect and polarity pairs, in every population, and their original products."""
    spark = rows.sparkSession
    hit = rows.where("label = 0").join(pairs.select(F.col("review_id").alias("source_review_id"), "aspect", "sentiment").distinct(), "source_review_id")
    own = lambda p: F.array_contains("populations", p)
    n = hit.groupBy("aspect", "sentiment").agg(*[F.count_if(own(p)).alias(p) for p in POPULATIONS], F.count_distinct(F.when(own("original"), F.col("product_id"))).alias("products"))
    grid = aspects(spark).select("aspect").crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("sentiment"))))
    return grid.join(n, ["aspect", "sentiment"], "left").na.fill(0)


def draft_counts(drafts: DataFrame) -> DataFrame:
    """One row: drafts by status and, of the pending ones, by class."""
    s = F.col("review_status")
    return drafts.agg(*[F.count_if(s == x).alias(x) for x in ("approved", "pending", "rejected")], *[F.count_if((s == "pending") & (F.col("ground_truth") == c)).alias(f"pending_{c}") for c in CLASSES])


def draft_variants(drafts: DataFrame) -> DataFrame:
    """Drafts of each source."""
    return drafts.groupBy("source_review_id").agg(F.count("*").alias("variants"))


def minority_sources(training: DataFrame) -> DataFrame:
    """Training rows of the two small classes, with what is to be confirmed before they are multiplied."""
    check = F.when(F.col("label") == 1, "indicators beyond rating and image").otherwise("text about something else")
    return training.where(F.col("label").isin(1, 3)).select("review_id", "product_id", "fold", "label", check.alias("check"))


def sparse_sources(training: DataFrame, pairs: DataFrame, least: int = 10) -> DataFrame:
    """Authentic training rows that hold a pair which fewer than ``least`` of them hold, with those pairs in order."""
    own = pairs.join(training.where("label = 0").select("review_id"), "review_id", "left_semi").select("review_id", "aspect", "sentiment").distinct()
    few = own.groupBy("aspect", "sentiment").agg(F.count("*").alias("n")).where(F.col("n") < least).drop("n")
    hit = own.join(F.broadcast(few), ["aspect", "sentiment"])  # 30 rows at most
    return hit.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("aspect", "sentiment"))), lambda x: F.concat_ws("/", x["aspect"].cast("string"), x["sentiment"].cast("string"))), ",").alias("pairs"))


def source_issue(category: Column, evidence: Column, polarity: Column, title: Column, text: Column) -> Column:
    """Why an annotation of an authentic source should not be multiplied, or null; the first reason counts."""
    # Product and description words of the rules.
    goods, said = "mouse|earphone|earbud|headset|speaker|monitor|webcam|shoes|pants", "(?i)description|advertis|picture|listed|as shown|specification|size chart|nakalagay"
    return (
        F.when((category == "sensory_experience") & F.lower(title).rlike(goods), "sensory_of_other_goods")
        .when((category == "accuracy_of_description") & (polarity == 1) & ~evidence.rlike(said), "no_comparison_stated")
        .when((category == "seller_service") & F.rtrim(evidence).endswith("?"), "question_alone")
        .when(~F.contains(text, evidence), "evidence_not_in_text")
    )


def best_so_far(history: DataFrame, by: str) -> DataFrame:
    """Of each run the step with the best score, the earliest of equals (``score``, ``step``)."""
    return history.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "step"))).where("r = 1").drop("r")


def checkpoint_at(history: DataFrame, checkpoints: DataFrame, by: str) -> DataFrame:
    """Of each run the saved step whose score is best; steps that weren't saved don't count."""
    return best_so_far(history.join(checkpoints.select(by, "step").distinct(), [by, "step"], "left_semi"), by)


def prepare_cases(cases: DataFrame) -> DataFrame:
    """What a request with each case should be answered with (200 or 422), and whether its description is cut.

    ``cases``: review_id, review_text, star_rating (text), image_urls (cut by bars), product_description.
    """
    x = F.trim("star_rating").try_cast("double")
    urls = F.filter(F.transform(F.split(F.coalesce("image_urls", F.lit("")), r"\|"), lambda u: F.trim(u)), lambda u: u != "")
    text = F.col("review_text")
    good = F.coalesce(~F.isnan(x) & (x == F.floor(x)) & x.between(1, 5), F.lit(False)) & F.coalesce((F.trim(text) != "") & (F.length(text) <= 2000), F.lit(False)) & (F.size(urls) <= 5) & F.forall(urls, lambda u: u.rlike("^https?://[^/?#]+"))
    return cases.select("review_id", F.when(good, 200).otherwise(422).alias("expected_status"), (F.length("product_description") > 2000).alias("cut"), F.substring("product_description", 1, 2000).alias("description"))


def score_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """For each case: whether the label is right, and whether its pairs are exactly those expected, as often.

    ``cases``: review_id, label, expected (array of text); ``answers``: review_id, label, pairs (array of text).
    """
    j = cases.join(answers.select("review_id", F.col("label").alias("answer"), "pairs"), "review_id", "left")
    return j.select("review_id", F.coalesce(F.col("answer") == F.lower("label"), F.lit(False)).alias("label_right"), F.coalesce(F.array_sort("expected") == F.array_sort("pairs"), F.lit(False)).alias("pairs_right"))


def capability(cases: DataFrame) -> DataFrame:
    """For each case: expected aspects met with their polarity, missed ones, and aspects beyond them (``expected`` and ``found`` are maps)."""
    e, f = F.col("expected"), F.col("found")
    met = F.filter(F.map_keys(e), lambda k: F.coalesce(F.try_element_at(f, k) == F.element_at(e, k), F.lit(False)))
    return cases.select("id", F.size(met).alias("met"), (F.size(F.map_keys(e)) - F.size(met)).alias("missed"), F.array_join(F.array_sort(F.array_except(F.map_keys(f), F.map_keys(e))), ",").alias("extra"))


def publish_violations(reviews: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: why a report may not be published: rows not of test, repeated ids, unknown labels, metrics out of range."""
    names = list(CLASSES)
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    rows = reviews.agg(is_(F.col("partition") != "test").alias("not_test"), (F.count("id") - F.count_distinct("id")).alias("repeated"), is_(~F.col("label").isin(names) | ~F.col("ground_truth").isin(names)).alias("unknown_label"))
    return rows.crossJoin(metrics.agg(F.count_if(F.isnan("value") | ~F.col("value").between(0, 1)).alias("out_of_range")))


def published(reviews: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` comparisons by id, without texts and names."""
    return reviews.orderBy("id").limit(most).select("id", "ground_truth", "label", (F.col("ground_truth") == F.col("label")).alias("correct"))


def matrix_problems(confusion: DataFrame, k: int = 4) -> DataFrame:
    """One row: cells of a confusion table ``actual, pred, n`` that are missing, repeated, outside of ``k`` labels, or no count."""
    c = confusion.withColumn("inside", F.coalesce(F.col("actual").between(0, k - 1) & F.col("pred").between(0, k - 1), F.lit(False)))
    own = c.where("inside").groupBy("actual", "pred").agg(F.count("*").alias("times"))
    cells = own.agg((F.lit(k * k) - F.count("*")).alias("missing_cells"), F.count_if(F.col("times") > 1).alias("repeated_cells"))
    n = F.col("n")
    return cells.crossJoin(c.agg(F.count_if(~F.col("inside")).alias("other_cells"), F.count_if(F.coalesce((n < 0) | (n != F.floor(n)) | F.isnan(n.cast("double")), F.lit(True))).alias("bad_counts")))  # one row with one


def publication(reviews: DataFrame, confusion: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row to publish: ``source_sha256`` (of the rows that may be published, by id), ``comparisons`` and ``samples`` (JSON of the first 20); rows that break a rule raise.

    ``reviews``: id, partition, ground_truth, label and whatever else a report holds: nothing else leaves it.
    """
    bad = publish_violations(reviews, metrics).crossJoin(matrix_problems(confusion, len(CLASSES))).first().asDict()  # one row with one
    if any(bad.values()):
        raise ValueError(f"not to be published: {', '.join(k for k, v in bad.items() if v)}")
    open_ = reviews.select("id", "ground_truth", "label")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "ground_truth", "label", "correct"))), lambda x: F.to_json(x)), ",")
    samples = published(open_).agg(F.concat(F.lit("["), told, F.lit("]")).alias("samples"))
    return ordered_digest(open_, ["id"]).select(F.col("digest").alias("source_sha256"), F.col("rows").alias("comparisons")).crossJoin(samples)


def class_report(confusion: DataFrame, k: int = 4) -> DataFrame:
    """Precision, recall, F1 and support of each class from a confusion table ``actual, pred, n`` alone."""
    rows = confusion.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = confusion.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    p, r = F.when(F.col("predicted") == 0, 0.0).otherwise(F.col("tp") / F.col("predicted")), F.when(F.col("support") == 0, 0.0).otherwise(F.col("tp") / F.col("support"))
    return rows.join(cols, "label").join(classes(confusion.sparkSession), "label").select("label", "class", "support", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 9).alias("f1"))


def model_pairs(a: DataFrame, b: DataFrame, on: str = "product_id") -> DataFrame:
    """Two models' values of each product side by side, and the change (``value``)."""
    j = a.select(on, F.col("value").alias("first")).join(b.select(on, F.col("value").alias("second")), on)
    return j.withColumn("change", F.round(F.col("second") - F.col("first"), 9))


def markdown(df: DataFrame, order: str, most: int = 200) -> str:
    """A small result as a Markdown table (at most ``most`` rows, by ``order``)."""
    show = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    rows = [df.columns, ["-"] * len(df.columns), *[[show(v) for v in r] for r in df.orderBy(order).limit(most).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
