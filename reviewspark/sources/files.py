"""Tables with a sidecar of metadata, reports, caches and experiments as files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions.contract import annotation_pairs, map_polarity, parse_image_urls
from reviewspark.operators import augment, provenance, splits
from reviewspark.operators.audit import same_rows
from reviewspark.sources.reviews import read_reviews

OOF = "review_id string, product_id string, fold int, probability_source string, probabilities array<double>"
FEATURES = "review_id string, product_id string, partition string, fold int, ground_truth int, probability_source string, dim1 double, dim2 double, dim3 double, dim4 double, dim5 double, dim6 double"
# Labels of the narrower table.
NARROW_LABELS = {"authentic": 0, "deceptive": 1, "liv": 2, "vague": 2, "irrelevant": 3}
NARROW_COLUMNS = ("review_id", "product_id", "review_text", "review_image_urls", "ground_truth", "aspect_annotations")


def write_with_meta(df: DataFrame, path: str, meta: dict[str, object]) -> None:
    """A table as Parquet and one JSON row of metadata beside it; a folder that exists raises. The metadata comes last."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    row = df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("errorifexists").text(f"{path}/meta")


def read_with_meta(spark: SparkSession, path: str, schema: str, expected: dict[str, object]) -> DataFrame:
    """The table of ``write_with_meta``; metadata that differs from what is expected raises."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    wrong = sorted(k for k, v in expected.items() if meta.get(k) != v)
    if wrong:
        raise ValueError(f"metadata differs: {', '.join(wrong)}")
    return spark.read.schema(schema).parquet(f"{path}/rows")


def write_oof(oof: DataFrame, path: str, fingerprint: str) -> None:
    """Out-of-fold predictions with the digest of the reviews they belong to."""
    write_with_meta(oof, path, {"dataset_sha256": fingerprint, "target": "text_label", "folds": sorted(r["fold"] for r in oof.select("fold").distinct().collect())})


def read_oof(assigned: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """Predictions of exactly the training reviews; any other table, and rows that break a rule, raise."""
    oof = read_with_meta(assigned.sparkSession, path, OOF, {"dataset_sha256": fingerprint, "target": "text_label", "folds": list(range(5))})
    bad = [k for k, v in provenance.oof_violations(oof, assigned).first().asDict().items() if v]
    if bad:
        raise ValueError(f"predictions break: {', '.join(bad)}")
    return oof


def write_features(features: DataFrame, path: str, fingerprint: str) -> None:
    write_with_meta(features, path, {"dataset_sha256": fingerprint, "dims": 6})


def read_features(assigned: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """A feature table that fits the split; others raise."""
    features = read_with_meta(assigned.sparkSession, path, FEATURES, {"dataset_sha256": fingerprint, "dims": 6})
    bad = [k for k, v in provenance.feature_violations(features, assigned).first().asDict().items() if v]
    if bad:
        raise ValueError(f"features break: {', '.join(bad)}")
    return features


def write_drafts(drafts: DataFrame, path: str, version: int) -> str:
    """Drafts as CSV in a folder of their version, next to all earlier ones, which stay as they are."""
    at = f"{path}/v{version:05d}"
    augment.check_columns(drafts).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(at)
    return at


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts from CSV: all columns as trimmed text, empties kept; missing or further columns raise."""
    return augment.check_columns(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill(""))


def read_narrow_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The smaller review table of the comparison model: fewer columns, five label names, annotations as a map of polarities by category."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")
    missing = sorted(set(NARROW_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return narrow_reviews(raw)


def narrow_reviews(raw: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in NARROW_LABELS.items() for x in kv])
    items = F.from_json("aspect_annotations", "array<struct<category:string,text:string,sentiment:string>>")
    keys = F.array_sort(F.array_distinct(F.transform(items, lambda x: x["category"])))
    polarity = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(items, lambda x: x["category"] == k), lambda x: map_polarity(x["sentiment"]))))))
    return raw.withColumns({"label": F.try_element_at(names, F.lower(F.trim("ground_truth"))), "image_urls": parse_image_urls(F.col("review_image_urls")), "polarities": polarity})


def multi_hot(polarities: Column, aspects: tuple[str, ...]) -> Column:
    """Which of the aspects are present, then for each which of three polarities, as zeros and ones."""
    at = lambda a: F.coalesce(F.try_element_at(polarities, F.lit(a)), F.array().cast("array<int>"))
    return F.struct(F.array(*[(F.size(at(a)) > 0).cast("int") for a in aspects]).alias("detection"), F.array(*[F.array(*[F.array_contains(at(a), i).cast("int") for i in range(3)]) for a in aspects]).alias("sentiment"))


def read_lenient_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Requests of the comparison service: unknown fields are ignored, ids must be given and differ."""
    r = F.from_json(body, "reviews array<struct<id:string,text:string,imageUrls:array<string>>>")
    ids = F.transform(r["reviews"], lambda x: x["id"])
    rules = [("not_json", r.isNull() | r["reviews"].isNull()), ("no_id", F.exists(ids, lambda i: F.trim(F.coalesce(i, F.lit(""))) == "")), ("duplicate_id", F.size(F.array_distinct(ids)) < F.size(ids))]
    return df.withColumn("request", r).withColumn("problems", F.array_compact(F.array(*[F.when(c, n) for n, c in rules])))


def case_problems(cases: DataFrame, labels: tuple[str, ...], aspects: tuple[str, ...]) -> DataFrame:
    """Diagnostic cases (``review_id, ground_truth, aspects, sentiment``, the last two JSON lists) with what is wrong with each."""
    a, s = F.from_json("aspects", "array<string>"), F.from_json("sentiment", "array<string>")
    twice = cases.groupBy("review_id").agg((F.count("*") > 1).alias("twice"))
    rules = [
        ("blank_id", F.coalesce("review_id", F.lit("")) == ""), ("duplicate_id", F.col("twice")), ("unknown_label", ~F.coalesce(F.lower("ground_truth").isin(*labels), F.lit(False))), ("lists_differ", ~F.coalesce(F.size(a) == F.size(s), F.lit(False))),
        ("unknown_aspect", F.size(F.array_except(a, F.array(*map(F.lit, aspects)))) > 0), ("unknown_sentiment", F.size(F.array_except(s, F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")))) > 0),
    ]
    return cases.join(twice, "review_id").withColumn("pairs", F.arrays_zip(a.alias("aspect"), s.alias("sentiment"))).withColumn("problems", F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).drop("twice")


def stored_images(urls: DataFrame, store: DataFrame) -> DataFrame:
    """Addresses with the length and digest of what the store (``path, length, content`` of a binary scan) holds under the SHA-256 of the address."""
    key = F.regexp_extract("path", r"([0-9a-f]{64})(?:\.[a-z]+)?$", 1)
    held = store.select(key.alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
    return urls.withColumn("key", F.sha2("url", 256)).join(held, "key", "left")


def cached_vectors(wanted: DataFrame, cache: DataFrame, compute: callable) -> DataFrame:  # type: ignore[valid-type]
    """Vectors of all wanted contents: those of the cache, and what ``compute`` makes of the contents that it lacks.

    ``wanted``: content (a struct or text); ``cache``: content_key, vector. Equal contents are computed once.
    """
    keyed = wanted.select("content").withColumn("content_key", F.sha2(F.to_json(F.struct("content")), 256))
    missing = keyed.join(cache.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"])
    return cache.select("content_key", "vector").unionByName(compute(missing).select("content_key", "vector"))


def reverified(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Cached visual features against the scores they came from: rows where best score, best address or chances don't agree."""
    best = scores.groupBy("review_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"), "url")).alias("t"))
    j = features.join(best, "review_id", "full")
    off = ~F.coalesce(F.abs(F.col("similarity") - F.coalesce("t.score", F.lit(0.0))) <= 1e-6, F.lit(False))
    return j.select("review_id", off.alias("score_differs"), (~F.col("best_url").eqNullSafe(F.col("t.url"))).alias("image_differs")).where("score_differs or image_differs")


def load_experiment(spark: SparkSession, path: str, manifest: str, fingerprint: str, drafts: DataFrame | None = None, with_pending: bool = False) -> DataFrame:
    """Reviews of a CSV with their split, and usable drafts behind them; drafts that break a rule raise."""
    reviews = splits.read_manifest(read_reviews(spark, path, annotations=True), manifest, fingerprint)
    return reviews if drafts is None else with_drafts(reviews, drafts, with_pending)


def with_drafts(reviews: DataFrame, drafts: DataFrame, with_pending: bool = False) -> DataFrame:
    """Assigned reviews and usable drafts; a draft takes what it doesn't state from its source."""
    chosen = augment.usable(augment.check_columns(drafts), with_pending)
    bad = augment.draft_violations(chosen, reviews.withColumn("text_label", F.col("text_target")))
    first = bad.first()
    if first:
        raise ValueError(f"draft {first['review_id']}: {', '.join(first['reasons'])}")
    own = ("review_id", "review_text", "aspect_annotations", "source_review_id", "augmentation_method")
    rest = [c for c in reviews.columns if c not in own]
    added = chosen.select(*own).join(reviews.select(F.col("review_id").alias("source_review_id"), *rest), "source_review_id")
    return reviews.unionByName(added, allowMissingColumns=True).fillna("", ["source_review_id", "augmentation_method"]).withColumn("pairs", annotation_pairs(F.col("aspect_annotations"), F.col("review_text")))


def export_json(payload: DataFrame, analysis: DataFrame, on: str) -> DataFrame:
    """Input and analysis of each key as one JSON document."""
    pack = lambda df, n: df.select(on, F.struct(*[c for c in df.columns if c != on]).alias(n))
    return pack(payload, "input").join(pack(analysis, "analysis"), on).select(on, F.to_json(F.struct(F.lit("1.0").alias("schemaVersion"), "input", "analysis")).alias("document"))


def write_bundle(parts: dict[str, DataFrame], path: str, meta: dict[str, object]) -> None:
    """Tables of a bundle, each in a folder of its name, and behind them a manifest with their rows, columns and the metadata."""
    if not parts:
        raise ValueError("a bundle needs a table")
    spark = next(iter(parts.values())).sparkSession
    rows = {}
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        rows[name] = {"rows": spark.read.parquet(f"{path}/{name}").count(), "columns": df.columns}
    spark.createDataFrame([(json.dumps({**meta, "parts": rows}, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str, expected: dict[str, object]) -> dict[str, DataFrame]:
    """Tables of a bundle whose manifest has the expected metadata and whose tables have the rows and columns it names; others raise."""
    meta = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    wrong = sorted(k for k, v in expected.items() if meta.get(k) != v)
    out = {}
    for name, told in meta["parts"].items():
        out[name] = spark.read.parquet(f"{path}/{name}")
        wrong += [name] if (out[name].count(), out[name].columns) != (told["rows"], told["columns"]) else []
    if wrong:
        raise ValueError(f"bundle differs: {', '.join(wrong)}")
    return out


def assemble(parts: dict[str, DataFrame], cohorts: tuple[DataFrame, DataFrame], path: str, meta: dict[str, object]) -> None:
    """Write a bundle, but only of models whose cohorts hold the same rows on the columns they share."""
    if not same_rows(*cohorts):
        raise ValueError("the cohorts of the models differ")
    write_bundle(parts, path, meta)
