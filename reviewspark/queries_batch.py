"""Queries of whole runs and of what is left of pages, weights and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions import contract as C
from reviewspark.functions import text as T
from reviewspark.operators import audit, metrics, views, weights
from reviewspark.operators.ordering import kept
from reviewspark.plans import batch
from reviewspark.plans import relation as R
from reviewspark.queries import _CM, _PER, on_reviews, query
from reviewspark.queries_files import folder
from reviewspark.queries_panel import picked, sql_picked
from reviewspark.sources import files
from reviewspark.streaming import scans

_ASPECTS = "['product_quality','functionality','performance','design','aesthetics','sensory_experience','value','packaging','seller_service','accuracy_of_description']"
_PAIRS = f"string_agg({_ASPECTS}[aspect + 1] || '/' || ['Negative', 'Neutral', 'Positive'][sentiment + 1], ',' ORDER BY aspect, sentiment)"


@on_reviews("aspects_file", f"SELECT r.review_id, coalesce(p.pairs, '') AS pairs FROM reviews r LEFT JOIN (SELECT review_id, {_PAIRS} AS pairs FROM predicted GROUP BY 1) p USING (review_id) WHERE r.pred = 0")
def aspects_file(r: DataFrame) -> DataFrame:
    """Pairs of reviews classified as authentic, written as JSON and read back."""
    path = folder(r.sparkSession, "aspects")
    batch.score_aspects(r.select("doc_id", "review_id", F.col("pred").alias("label")), R.predicted_pairs, path, authentic_only=True)
    return _read_pairs(r.sparkSession, path)


def _read_pairs(spark: SparkSession, path: str) -> DataFrame:
    back = spark.read.schema("review_id string, aspectSentiment array<struct<category:string,sentiment:string>>").json(path)
    return back.select("review_id", F.array_join(F.transform("aspectSentiment", lambda x: F.concat_ws("/", x["category"], x["sentiment"])), ",").alias("pairs"))


@on_reviews("part_file", f"SELECT r.review_id, coalesce(p.pairs, '') AS pairs FROM assigned r LEFT JOIN (SELECT review_id, {_PAIRS} AS pairs FROM predicted GROUP BY 1) p USING (review_id) WHERE r.part = 'test'")
def part_file(r: DataFrame) -> DataFrame:
    path = folder(r.sparkSession, "part")
    batch.predict_part(R.assigned(r), R.predicted_pairs, path, "test")
    return _read_pairs(r.sparkSession, path)


@on_reviews("oof_generated", "SELECT review_id, fold, 'oof_fold_' || fold AS source, 1.0::DOUBLE AS total FROM assigned WHERE part = 'train'")
def oof_generated(r: DataFrame) -> DataFrame:
    """Cross-fitted predictions of a text classifier: one for every training review, by a model that saw none of its fold."""
    a = batch.hashed_words(R.assigned(r).where("partition = 'train'").withColumn("label", F.col("truth")), 1 << 10)
    a = kept(a.select("review_id", "product_id", "partition", "fold", "label", "counts"), "hashed")
    out = batch.cross_fit(a, batch.text_classifier("label", 1 << 10, 5))
    return out.select("review_id", "fold", F.col("probability_source").alias("source"), F.round(F.aggregate("probabilities", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@on_reviews("export_documents", "SELECT review_id, '1.0' AS version, star_rating, ['authentic', 'deceptive', 'liv', 'irrelevant'][pred + 1] AS label FROM reviews")
def export_documents(r: DataFrame) -> DataFrame:
    """Input and analysis as one document, read back."""
    name = F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col("pred") + 1)
    docs = files.export_json(r.select("review_id", "star_rating"), r.select("review_id", name.alias("label")), "review_id")
    x = F.from_json("document", "schemaVersion string, input struct<star_rating:int>, analysis struct<label:string>")
    return docs.select("review_id", x.alias("x")).select("review_id", F.col("x.schemaVersion").alias("version"), "x.input.star_rating", "x.analysis.label")


_WORDS = ("Good, GOOD sound!", "no-match here", "a <b> & \"good\" 'x'", "")


@on_reviews("lexical_keys", f"SELECT review_id, array_to_string(regexp_extract_all(lower({sql_picked(_WORDS)}), '[0-9A-Za-z_]+'), ' ') AS key FROM reviews")
def lexical_keys(r: DataFrame) -> DataFrame:
    return r.select("review_id", C.lexical_key(picked(_WORDS)).alias("key"))


@on_reviews("highlights", f"SELECT review_id, regexp_replace(replace(replace(replace(replace(replace({sql_picked(_WORDS)}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;'), '(?i)(good)', '<mark>\\1</mark>', 'g') AS html FROM reviews")
def highlights(r: DataFrame) -> DataFrame:
    return r.select("review_id", T.highlight(picked(_WORDS), "good").alias("html"))


@on_reviews("families_ordered", ", f AS (SELECT family, count(*) AS n FROM fam GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, family) AS place, family, n FROM f ORDER BY n DESC, family LIMIT 100")
def families_ordered(r: DataFrame) -> DataFrame:
    """The hundred largest families."""
    return views.ranked(R.families(r).groupBy("family").agg(F.count("*").alias("n")), [F.desc("n"), F.col("family")], 100)


@on_reviews("family_consistency", ", x AS (SELECT id, family, CASE WHEN id % 17 = 1 THEN (label + 1) % 4 ELSE label END AS label, CASE WHEN id % 19 = 1 THEN 'other' ELSE 'p' END AS product, CASE WHEN id % 23 = 0 THEN id ELSE family END AS fm FROM fam) SELECT count(*) FILTER (l > 1) AS labels_differ, count(*) FILTER (p > 1) AS products_differ, count(*) FILTER (NOT own) AS without_original FROM (SELECT family, count(DISTINCT label) AS l, count(DISTINCT product) AS p, bool_or(id = family AND id % 29 <> 0) AS own FROM x GROUP BY 1)")
def family_consistency(r: DataFrame) -> DataFrame:
    """Families whose rows differ in label or product, or that lack their original."""
    i = F.col("id")
    rows = R.families(r).withColumns({"label": F.when(i % 17 == 1, (F.col("label") + 1) % 4).otherwise(F.col("label")), "product": F.when(i % 19 == 1, "other").otherwise("p"), "original": (i == F.col("family")) & (i % 29 != 0)})
    return weights.family_violations(rows)


@on_reviews("weights_aligned", ", w AS (SELECT id, round((SELECT count(*) FROM fam) / ((SELECT count(DISTINCT label) FROM fam) * count(*) OVER (PARTITION BY label)), 9) AS weight FROM fam) SELECT review_id, weight FROM w JOIN reviews r ON r.doc_id = w.id WHERE r.pred = 0")
def weights_aligned(r: DataFrame) -> DataFrame:
    """Weights joined to the rows they belong to by id, whatever the order of either."""
    w = weights.row_balanced(R.families(r))
    return r.where("pred = 0").join(w.withColumnRenamed("id", "doc_id"), "doc_id").select("review_id", "weight")


@on_reviews("weight_summary", ", w AS (SELECT family, label, (SELECT count(*) FROM fam) / (4 * (SELECT count(DISTINCT family) FROM fam g WHERE g.label = f.label) * count(*) OVER (PARTITION BY family)) AS weight FROM fam f) SELECT label, count(DISTINCT family) AS families, count(*) AS rows, round(sum(round(weight, 9)), 5) AS total FROM w GROUP BY 1")
def weight_summary(r: DataFrame) -> DataFrame:
    f = R.families(r)
    return weights.source_class_balanced(f).join(f, "id").groupBy("label").agg(F.count_distinct("family").alias("families"), F.count("*").alias("rows"), F.round(F.sum("weight"), 5).alias("total"))


@on_reviews("formatted_aspects", f"SELECT p.review_id, {_ASPECTS}[p.aspect + 1] AS category, ['Negative', 'Neutral', 'Positive'][p.sentiment + 1] AS sentiment, sha256(r.review_text) AS evidence FROM predicted p JOIN reviews r USING (review_id)")
def formatted_aspects(r: DataFrame) -> DataFrame:
    """The comparison model's pairs, with the whole review as evidence."""
    named = batch.named_pairs(r, R.predicted_pairs(r))
    return named.select("review_id", F.explode("aspectSentiment").alias("x"), "review_text").select("review_id", "x.category", "x.sentiment", F.sha2("review_text", 256).alias("evidence"))


@on_reviews("gold_with_evidence", f"SELECT review_id, {_ASPECTS}[aspect + 1] AS category, sentiment, 'e' || aspect || ' f' || aspect AS evidence FROM gold")
def gold_with_evidence(r: DataFrame) -> DataFrame:
    """Gold pairs of annotations whose distinct evidence is joined by spaces."""
    g = R.gold_pairs(r).withColumns({"c": F.element_at(F.array(*map(F.lit, C.ASPECTS)), F.col("aspect") + 1), "s": F.element_at(F.array(*map(F.lit, C.POLARITIES)), F.col("sentiment") + 1), "a": F.col("aspect").cast("string")})
    item = lambda e: F.struct(F.col("c").alias("category"), F.concat(F.lit(e), "a").alias("text"), F.col("s").alias("sentiment"))
    doc = g.groupBy("review_id").agg(F.to_json(F.flatten(F.collect_list(F.array(item("e"), item("f"), item("e"))))).alias("json"))
    return doc.select("review_id", F.explode(C.parse_annotations(F.col("json"))).alias("a")).select("review_id", "a.category", "a.sentiment", F.array_join("a.evidence", " ").alias("evidence"))


@on_reviews("cache_cohort", "SELECT review_id FROM assigned WHERE part = 'test' OR truth = 0")
def cache_cohort(r: DataFrame) -> DataFrame:
    return R.assigned(r).where("partition = 'test' or truth = 0").select("review_id")


_DELTAS = f""", {_CM}, {_PER}, cm2 AS (SELECT a.label AS actual, p.label AS pred, count(r.truth) AS n FROM four a CROSS JOIN four p LEFT JOIN reviews r ON r.truth = a.label AND r.star_rating % 4 = p.label GROUP BY 1, 2),
per2 AS (SELECT f.label, (SELECT sum(n) FROM cm2 WHERE actual = f.label)::BIGINT AS support, (SELECT sum(n) FROM cm2 WHERE pred = f.label)::BIGINT AS predicted, (SELECT sum(n) FROM cm2 WHERE actual = f.label AND pred = f.label)::BIGINT AS tp FROM four f),
pr2 AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM per2), m2 AS (SELECT label, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr2)
SELECT 'all' AS cohort, round((SELECT round(avg((truth = pred)::INT), 9) - round(avg((truth = star_rating % 4)::INT), 9) FROM reviews), 9) AS accuracy_delta, """ + ", ".join(f"round((SELECT round(avg(round({c}, 9)), 6) FROM m) - (SELECT round(avg(round({c}, 9)), 6) FROM m2), 9) AS macro_{n}_delta" for c, n in (("p", "precision"), ("r", "recall"), ("f1", "f1")))


@on_reviews("metric_deltas", _DELTAS)
def metric_deltas(r: DataFrame) -> DataFrame:
    """Four metrics of one model less those of another."""
    one = metrics.macro(r.select(F.lit("all").alias("cohort"), F.col("truth").alias("actual"), "pred"), ("cohort",))
    two = metrics.macro(r.select(F.lit("all").alias("cohort"), F.col("truth").alias("actual"), (F.col("star_rating") % 4).cast("int").alias("pred")), ("cohort",))
    return audit.metric_delta(one, two, ["cohort"], ["accuracy", "macro_precision", "macro_recall", "macro_f1"])


@query("latest_runs", "SELECT user_id, max(event_id) AS run, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1", False)
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The last run of each key; what earlier ones still bring is stale."""
    return scans.latest(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_id").select("user_id", F.col("event_id").alias("run"), "event_type")


@query("changed_scans", "SELECT DISTINCT user_id AS key, event_type AS signature FROM events", False)
def changed_scans(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_type").alias("signature"))
    return scans.changes(e)


@on_reviews("half_even", "SELECT doc_id, round_even(doc_id / 8.0, 2)::DOUBLE AS even, floor(doc_id / 8.0 * 10 + 0.5)::BIGINT AS up FROM reviews")
def half_even(r: DataFrame) -> DataFrame:
    x = F.col("doc_id") / 8.0
    return r.select("doc_id", F.bround(x, 2).alias("even"), F.floor(x * 10 + 0.5).alias("up"))
