"""Queries of reports: balance of augmentation, greedy fill, diagnostic cases, publication, ablation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions import contract as C
from reviewspark.functions import text as T
from reviewspark.operators import ablation, fill, metrics, panels, reports, summary
from reviewspark.plans import relation as R
from reviewspark.queries import _ABL, _CM, _PRODUCT, _pairs, as_predicted, judged, on_reviews
from reviewspark.queries_panel import picked, sql_picked


def training(r: DataFrame) -> DataFrame:
    """Training reviews with two targets."""
    a = R.assigned(r).where("partition = 'train'")
    return a.select("doc_id", "review_id", "product_id", "fold", F.col("truth").alias("label"), ((F.col("truth") + (F.col("doc_id") % 7 == 0).cast("int")) % 4).alias("text_label"), "review_text")


def some_drafts(r: DataFrame) -> DataFrame:
    """Drafts of every third training review."""
    d = F.col("doc_id")
    t = training(r).where(d % 3 == 0)
    return t.select(F.concat(F.lit("d_"), "review_id").alias("review_id"), F.col("review_id").alias("source_review_id"), F.element_at(F.array(F.lit("approved"), F.lit("pending"), F.lit("rejected")), (F.floor(d / 3) % 3 + 1).cast("int")).alias("review_status"), F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col("label") + 1).alias("ground_truth"))


_TRAIN = """, tr AS (SELECT doc_id, review_id, product_id, fold, truth AS label, ((truth + (doc_id % 7 = 0)::INT) % 4)::INT AS text_label FROM assigned WHERE part = 'train'),
dr AS (SELECT doc_id, 'd_' || review_id AS review_id, review_id AS source, ['approved', 'pending', 'rejected'][(doc_id // 3) % 3 + 1] AS status, label FROM tr WHERE doc_id % 3 = 0),
po AS (SELECT review_id AS source, unnest(['original', 'active', 'projected']) AS population, label, text_label, product_id FROM tr UNION ALL SELECT source, unnest(CASE WHEN status = 'approved' THEN ['active', 'projected'] ELSE ['projected'] END), t.label, text_label, product_id FROM dr JOIN tr t ON t.review_id = dr.source WHERE status <> 'rejected')"""


@on_reviews("balance_quality", _TRAIN + ", g AS (SELECT p.population, t.target, f.label FROM (SELECT unnest(['original', 'active', 'projected']) AS population) p CROSS JOIN (SELECT unnest(['ground_truth', 'text_label']) AS target) t CROSS JOIN four f), c AS (SELECT population, 'ground_truth' AS target, label, count(*) AS n FROM po GROUP BY ALL UNION ALL SELECT population, 'text_label', text_label, count(*) FROM po GROUP BY ALL) SELECT population, target, label, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (population, target, label)")
def balance_quality(r: DataFrame) -> DataFrame:
    return reports.balance_quality(reports.populations(training(r), some_drafts(r)))


@on_reviews("balance_folds", _TRAIN + " SELECT fold, count(DISTINCT product_id) AS products, count(*) FILTER (label = 0) AS authentic, count(*) FILTER (label = 1) AS deceptive, count(*) FILTER (label = 2) AS liv, count(*) FILTER (label = 3) AS irrelevant FROM tr GROUP BY 1")
def balance_folds(r: DataFrame) -> DataFrame:
    return reports.balance_folds(training(r))


@on_reviews(
    "balance_aspects",
    _TRAIN
    + """, h AS (SELECT g.aspect, g.sentiment, po.* FROM po JOIN gold g ON g.review_id = po.source WHERE po.label = 0)
    SELECT a.aspect, s.s AS sentiment, count(*) FILTER (population = 'original') AS original, count(*) FILTER (population = 'active') AS active, count(*) FILTER (population = 'projected') AS projected, count(DISTINCT product_id) FILTER (population = 'original') AS products
    FROM aspects a CROSS JOIN (SELECT unnest(range(3))::INT AS s) s LEFT JOIN h ON h.aspect = a.aspect AND h.sentiment = s.s GROUP BY 1, 2""",
)
def balance_aspects(r: DataFrame) -> DataFrame:
    return reports.balance_aspects(reports.populations(training(r), some_drafts(r)), R.gold_pairs(r))


@on_reviews("draft_counts", _TRAIN + " SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("approved", "pending", "rejected")) + ", " + ", ".join(f"count(*) FILTER (status = 'pending' AND label = {i}) AS pending_{c}" for i, c in enumerate(C.CLASSES)) + " FROM dr")
def draft_counts(r: DataFrame) -> DataFrame:
    return reports.draft_counts(some_drafts(r))


@on_reviews("draft_variants", _TRAIN + " SELECT source_review_id, count(*) AS variants FROM (SELECT 'review_' || ((doc_id // 9) * 9) AS source_review_id FROM dr) GROUP BY 1")
def draft_variants(r: DataFrame) -> DataFrame:
    d = F.substring_index("source_review_id", "_", -1).cast("bigint")
    return reports.draft_variants(some_drafts(r).withColumn("source_review_id", F.concat(F.lit("review_"), (F.floor(d / 9) * 9).cast("string"))))


@on_reviews("minority_sources", _TRAIN + " SELECT review_id, product_id, fold, label, CASE WHEN label = 1 THEN 'indicators beyond rating and image' ELSE 'text about something else' END AS check FROM tr WHERE label IN (1, 3)")
def minority_sources(r: DataFrame) -> DataFrame:
    return reports.minority_sources(training(r))


@on_reviews("sparse_sources", _TRAIN + ", o AS (SELECT DISTINCT g.review_id, aspect, sentiment FROM gold g JOIN tr USING (review_id) WHERE label = 0), f AS (SELECT aspect, sentiment FROM o GROUP BY 1, 2 HAVING count(*) < 25) SELECT review_id, string_agg(aspect || '/' || sentiment, ',' ORDER BY aspect, sentiment) AS pairs FROM o JOIN f USING (aspect, sentiment) GROUP BY 1")
def sparse_sources(r: DataFrame) -> DataFrame:
    return reports.sparse_sources(training(r), R.gold_pairs(r), 25)


_EV = ("smells nice", "as advertised", "fine color", "will you answer? ", "not there")
_CAT = ("sensory_experience", "accuracy_of_description", "accuracy_of_description", "seller_service", "value", "seller_service")
_TITLE = ("Gaming Mouse", "Face cream")


@on_reviews(
    "source_issues",
    rf"""SELECT review_id, CASE WHEN c = 'sensory_experience' AND regexp_matches(lower(t), 'mouse|earphone|earbud|headset|speaker|monitor|webcam|shoes|pants') THEN 'sensory_of_other_goods'
      WHEN c = 'accuracy_of_description' AND p = 1 AND NOT regexp_matches(e, '(?i)description|advertis|picture|listed|as shown|specification|size chart|nakalagay') THEN 'no_comparison_stated'
      WHEN c = 'seller_service' AND rtrim(e) LIKE '%?' THEN 'question_alone' WHEN NOT contains('smells nice, as advertised, fine color, will you answer? ', e) THEN 'evidence_not_in_text' END AS issue
    FROM (SELECT review_id, {sql_picked(_CAT)} AS c, {sql_picked(_EV)} AS e, (doc_id % 3)::INT AS p, {sql_picked(_TITLE)} AS t FROM reviews)""",
)
def source_issues(r: DataFrame) -> DataFrame:
    text = F.lit("smells nice, as advertised, fine color, will you answer? ")
    return r.select("review_id", reports.source_issue(picked(_CAT), picked(_EV), (F.col("doc_id") % 3).cast("int"), picked(_TITLE), text).alias("issue"))


_LABELS = _TRAIN + ", hv AS (SELECT label, count(*) AS n FROM tr GROUP BY 1), sr AS (SELECT review_id, label, fold, product_id, doc_id % 3 AS used, doc_id % 5 AS cap FROM tr)"


@on_reviews("greedy_fill", _LABELS + ", us AS (SELECT *, used + unnest(range(cap)) AS use FROM sr WHERE cap > 0), rk AS (SELECT label, review_id, use, row_number() OVER (PARTITION BY label ORDER BY use, fold, product_id, review_id) AS turn FROM us) SELECT label, turn, review_id, use::BIGINT AS use FROM rk JOIN hv USING (label) WHERE turn <= greatest(0, (SELECT max(n) FROM hv) - n)")
def greedy_fill(r: DataFrame) -> DataFrame:
    t, d = training(r), F.col("doc_id")
    have = t.groupBy("label").agg(F.count("*").alias("n"))
    top = have.agg(F.max("n")).first()[0] or 0
    s = t.select("review_id", "label", "fold", "product_id", (d % 3).cast("int").alias("used"), (d % 5).cast("int").alias("capacity"))
    counts = {r["label"]: r["n"] for r in have.collect()}
    return fill.one_target(s, counts, top).select("label", F.col("turn").cast("bigint").alias("turn"), "review_id", F.col("use").cast("bigint").alias("use"))


#: Least number of authentic training reviews (with drafts) that hold each pair.
PAIR_MINIMUM = 12


@on_reviews(
    "greedy_targets",
    _TRAIN
    + f""", co AS (SELECT review_id, list(DISTINCT aspect * 3 + sentiment) AS codes FROM gold GROUP BY 1),
    sr AS (SELECT review_id, label, text_label, doc_id % 3 AS used, doc_id % 5 AS cap, CASE WHEN label = 0 THEN codes END AS codes, row_number() OVER (ORDER BY fold, product_id, review_id) AS i FROM tr JOIN co USING (review_id)),
    pc AS (SELECT c AS code, count(review_id) AS n FROM (SELECT unnest(range(30)) AS c) LEFT JOIN sr ON list_contains(codes, c) GROUP BY 1),
    st AS (
      SELECT 1 AS k, (SELECT list(used ORDER BY i) FROM sr) AS uses, (SELECT list(cap ORDER BY i) FROM sr) AS rest, (SELECT list(n ORDER BY code) FROM pc) AS cnt, (SELECT list(code ORDER BY n, code) FROM pc) AS po,
             (SELECT list(n ORDER BY label) FROM (SELECT f.label, count(tr.review_id) AS n FROM four f LEFT JOIN tr ON tr.label = f.label GROUP BY 1)) AS q, (SELECT list(n ORDER BY label) FROM (SELECT f.label, count(tr.review_id) AS n FROM four f LEFT JOIN tr ON tr.text_label = f.label GROUP BY 1)) AS t, 0::BIGINT AS goal, 0::BIGINT AS tgoal, 0::BIGINT AS pick, 0::BIGINT AS use, false AS done
      UNION ALL
      SELECT k + (k <= 30 AND p IS NULL)::INT, list_transform(uses, lambda x, j: x + (j = coalesce(p, 0))::INT), list_transform(rest, lambda x, j: x - (j = coalesce(p, 0))::INT),
             list_transform(cnt, lambda x, j: x + coalesce(list_contains(picked.codes, j - 1), false)::INT), po,
             list_transform(q, lambda x, j: x + coalesce(picked.label + 1 = j, false)::INT), list_transform(t, lambda x, j: x + coalesce(picked.text_label + 1 = j, false)::INT),
             CASE WHEN k <= 30 THEN list_max(q) ELSE goal END, CASE WHEN k <= 30 THEN list_max(t) ELSE tgoal END, coalesce(p, 0), coalesce(uses[p], 0), k = 31 AND p IS NULL
      FROM (SELECT st.*, CASE WHEN k <= 30 THEN (SELECT i FROM sr WHERE st.cnt[st.po[st.k] + 1] < {PAIR_MINIMUM} AND list_contains(codes, st.po[st.k]) AND st.rest[i] > 0 ORDER BY st.uses[i], i LIMIT 1)
            ELSE (SELECT i FROM sr WHERE st.rest[i] > 0 AND (st.goal > st.q[label + 1] OR st.tgoal > st.t[text_label + 1])
                  ORDER BY (st.goal > st.q[label + 1])::INT + (st.tgoal > st.t[text_label + 1])::INT DESC, st.uses[i], greatest(0, st.goal - st.q[label + 1]) + greatest(0, st.tgoal - st.t[text_label + 1]) DESC, i LIMIT 1) END AS p FROM st WHERE NOT done) LEFT JOIN sr AS picked ON picked.i = p)
    SELECT review_id, use FROM st JOIN sr ON i = pick""",
    recursive=True,
)
def greedy_targets(r: DataFrame) -> DataFrame:
    t, d = training(r), F.col("doc_id")
    pairs = R.gold_pairs(r)
    s = t.select("review_id", "label", "text_label", "fold", "product_id", (d % 3).cast("int").alias("used"), (d % 5).cast("int").alias("capacity"))
    own = pairs.join(t.where("label = 0"), "review_id", "left_semi").groupBy("aspect", "sentiment").count().collect()
    count = lambda c: {x[0]: x[1] for x in t.groupBy(c).count().collect()}
    out = fill.fill_targets(s, pairs, count("label"), count("text_label"), {(x[0], x[1]): x[2] for x in own}, PAIR_MINIMUM)
    return out.picks.select("review_id", F.col("use").cast("bigint").alias("use"))


@on_reviews(
    "source_gains",
    _TRAIN + """, q AS (SELECT label, max(count(*)) OVER () - count(*) AS n FROM tr GROUP BY 1), t AS (SELECT text_label, max(count(*)) OVER () - count(*) AS n FROM tr GROUP BY 1)
    SELECT review_id, (q.n > 0)::INT + (t.n > 0)::INT AS targets, (q.n + t.n)::INT AS lacks FROM tr JOIN q USING (label) JOIN t USING (text_label)""",
)
def source_gains(r: DataFrame) -> DataFrame:
    """What each training review would help if every class were to grow to the largest of its target."""
    t = training(r)
    count = lambda c: {x[0]: x[1] for x in t.groupBy(c).count().collect()}
    lacks = lambda n: {k: max(n.values()) - v for k, v in n.items()}
    targets, lack = fill.gains(F.col("label"), F.col("text_label"), lacks(count("label")), lacks(count("text_label")))
    return t.select("review_id", targets.alias("targets"), lack.alias("lacks"))


_HISTORY = ", hi AS (SELECT product_id AS run, doc_id AS step, ((doc_id * 7) % 11) / 10.0 AS score FROM reviews)"


@on_reviews("best_so_far", _HISTORY + " SELECT run, step, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, step) AS r FROM hi) WHERE r = 1")
def best_so_far(r: DataFrame) -> DataFrame:
    return reports.best_so_far(_history(r), "run")


def _history(r: DataFrame) -> DataFrame:
    return r.select(F.col("product_id").alias("run"), F.col("doc_id").alias("step"), ((F.col("doc_id") * 7) % 11 / 10.0).alias("score"))


@on_reviews("checkpoint_at", _HISTORY + " SELECT run, step, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, step) AS r FROM hi WHERE step % 3 = 0) WHERE r = 1")
def checkpoint_at(r: DataFrame) -> DataFrame:
    h = _history(r)
    return reports.checkpoint_at(h, h.where("step % 3 = 0"), "run")


_STARS = ("5", "2.5", "0", " 4 ", "NaN", "", "3.0")
_IMAGES = ("https://a/b|https://c/d", "", "a.jpg", "https://1/x|https://2/x|https://3/x|https://4/x|https://5/x|https://6/x", "http://h | ")


@on_reviews(
    "prepared_cases",
    f"""SELECT review_id, CASE WHEN coalesce(NOT isnan(s) AND s = floor(s) AND s BETWEEN 1 AND 5, false) AND trim(review_text) <> '' AND length(review_text) <= 2000 AND len(u) <= 5 AND list_bool_and(list_concat([true], list_transform(u, lambda x: regexp_matches(x, '^https?://[^/?#]+')))) THEN 200 ELSE 422 END AS expected_status, n > 2000 AS cut, least(n, 2000) AS kept
    FROM (SELECT review_id, review_text, try_cast(trim({sql_picked(_STARS)}) AS DOUBLE) AS s, list_filter(list_transform(string_split({sql_picked(_IMAGES)}, '|'), lambda x: trim(x)), lambda x: x <> '') AS u, 1900 + doc_id % 200 AS n FROM reviews)""",
)
def prepared_cases(r: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    cases = r.select("review_id", "review_text", picked(_STARS).alias("star_rating"), picked(_IMAGES).alias("image_urls"), F.repeat(F.lit("x"), (1900 + d % 200).cast("int")).alias("product_description"))
    return reports.prepare_cases(cases).select("review_id", "expected_status", "cut", F.length("description").cast("bigint").alias("kept"))


_EXPECTED = ", ex AS (SELECT review_id, list_sort(list(aspect || '/' || sentiment)) AS e FROM gold GROUP BY 1), fo AS (SELECT review_id, list_sort(list(aspect || '/' || sentiment)) AS f FROM predicted GROUP BY 1)"


@on_reviews("scored_cases", _EXPECTED + " SELECT r.review_id, r.truth = r.pred AND r.doc_id % 9 <> 0 AS label_right, coalesce(e = f, false) AND r.doc_id % 9 <> 0 AS pairs_right FROM reviews r JOIN ex USING (review_id) LEFT JOIN fo USING (review_id)")
def scored_cases(r: DataFrame) -> DataFrame:
    """Answers to cases, every ninth of which has none."""
    name = lambda c: F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col(c) + 1)
    listed = lambda p, n: p.groupBy("review_id").agg(F.collect_list(F.concat_ws("/", F.col("aspect").cast("string"), F.col("sentiment").cast("string"))).alias(n))
    cases = r.select("review_id", F.upper(name("truth")).alias("label")).join(listed(R.gold_pairs(r), "expected"), "review_id")
    answers = r.where("doc_id % 9 <> 0").select("review_id", name("pred").alias("label")).join(listed(R.predicted_pairs(r), "pairs"), "review_id", "left")
    return reports.score_cases(cases, answers)


@on_reviews("capability_cases", ", e AS (SELECT review_id AS id, aspect, sentiment FROM gold), f AS (SELECT review_id AS id, aspect, sentiment FROM predicted) SELECT r.review_id AS id, (SELECT count(*) FROM e JOIN f USING (id, aspect, sentiment) WHERE id = r.review_id)::INT AS met, ((SELECT count(*) FROM e WHERE id = r.review_id) - (SELECT count(*) FROM e JOIN f USING (id, aspect, sentiment) WHERE id = r.review_id))::INT AS missed, coalesce((SELECT string_agg(aspect::VARCHAR, ',' ORDER BY aspect::VARCHAR) FROM f WHERE id = r.review_id AND aspect NOT IN (SELECT aspect FROM e WHERE e.id = r.review_id)), '') AS extra FROM reviews r")
def capability_cases(r: DataFrame) -> DataFrame:
    as_map = lambda p, n: p.groupBy(F.col("review_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("aspect").cast("string"), F.col("sentiment")))).alias(n))
    return reports.capability(as_map(R.gold_pairs(r), "expected").join(as_map(R.predicted_pairs(r), "found"), "id"))


@on_reviews("publish_violations", ", v AS (SELECT * FROM reviews UNION ALL SELECT * FROM reviews WHERE doc_id % 83 = 0) SELECT (SELECT count(*) FROM (SELECT a.part, v.doc_id FROM v JOIN assigned a USING (review_id) WHERE a.part <> 'test')) AS not_test, (SELECT count(*) - count(DISTINCT review_id) FROM v) AS repeated, (SELECT count(*) FROM v WHERE doc_id % 71 = 0) AS unknown_label, (SELECT count(*) FROM reviews WHERE doc_id % 13 IN (11, 12)) AS out_of_range")
def publish_violations(r: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    name = lambda c: F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col(c) + 1)
    a = R.assigned(r)
    rows = a.union(a.where(d % 83 == 0)).select(F.col("review_id").alias("id"), "partition", F.when(d % 71 == 0, "other").otherwise(name("pred")).alias("label"), name("truth").alias("ground_truth"))
    values = r.select(F.when(d % 13 == 12, F.lit(float("nan"))).otherwise(d % 13 / 10.0).alias("value"))
    return reports.publish_violations(rows, values)


@on_reviews("published_samples", "SELECT review_id AS id, ['authentic', 'deceptive', 'liv', 'irrelevant'][truth + 1] AS ground_truth, ['authentic', 'deceptive', 'liv', 'irrelevant'][pred + 1] AS label, truth = pred AS correct FROM assigned WHERE part = 'test' ORDER BY review_id LIMIT 20")
def published_samples(r: DataFrame) -> DataFrame:
    name = lambda c: F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col(c) + 1)
    return reports.published(R.assigned(r).where("partition = 'test'").select(F.col("review_id").alias("id"), name("truth").alias("ground_truth"), name("pred").alias("label"), "review_text"))


@on_reviews("class_report", f", {_CM}, s AS (SELECT f.label, (SELECT sum(n) FROM cm WHERE actual = f.label)::BIGINT AS support, (SELECT sum(n) FROM cm WHERE pred = f.label)::BIGINT AS pr, (SELECT sum(n) FROM cm WHERE actual = f.label AND pred = f.label)::BIGINT AS tp FROM four f) SELECT label, ['authentic', 'deceptive', 'liv', 'irrelevant'][label + 1] AS class, support, round(CASE WHEN pr = 0 THEN 0 ELSE tp / pr END, 9) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE tp / support END, 9) AS recall, round(CASE WHEN pr + support = 0 THEN 0 ELSE 2 * tp / (pr + support) END, 9) AS f1 FROM s")
def class_report(r: DataFrame) -> DataFrame:
    return reports.class_report(metrics.confusion(judged(r)))


@on_reviews("model_pair_comparison", f", x AS ({_PRODUCT.format(gate='AND r.pred = 0').strip()}), y AS ({_PRODUCT.format(gate='').strip()}) SELECT product_id, x.sentiment AS first, y.sentiment AS second, round(y.sentiment - x.sentiment, 9) AS change FROM x JOIN y USING (product_id)")
def model_pair_comparison(r: DataFrame) -> DataFrame:
    of = lambda gated: summary.product_sentiment(as_predicted(r), R.predicted_pairs(r), gated).select("product_id", F.col("sentiment").alias("value"))
    return reports.model_pairs(of(True), of(False))


@on_reviews("ablation_counts", _ABL + "SELECT aspect, count(*) AS products, count(*) FILTER (t IS NOT NULL) AS with_truth, count(*) FILTER (ok) AS paired, count(*) FILTER (t IS NOT NULL AND NOT ok) AS excluded, count(*) FILTER (t IS NULL) AS without_truth, count(*) FILTER (t IS NOT NULL AND f IS NULL) AS missing_filtered, count(*) FILTER (t IS NOT NULL AND u IS NULL) AS missing_unfiltered, count(*) FILTER (t IS NULL AND f IS NOT NULL) AS filtered_without_truth, count(*) FILTER (t IS NULL AND u IS NOT NULL) AS unfiltered_without_truth, round(avg(round(ue - fe, 9)) FILTER (ok), 6) AS improvement FROM ab GROUP BY 1")
def ablation_counts(r: DataFrame) -> DataFrame:
    return ablation.counts(_pairs(r))


# Topics of the panel's own analysis, in order, with their words.
TOPICS = {
    "Quality": ("quality", "matibay", "durable", "material", "build", "ganda", "finish", "sira"),
    "Performance": ("performance", "works", "gumagana", "fast", "mabilis", "battery", "sound", "audio", "camera"),
    "Value": ("price", "presyo", "sulit", "worth", "mahal", "cheap", "affordable"),
    "Delivery": T.DEFAULT.delivery,
    "Appearance": ("color", "kulay", "design", "look", "size", "laki", "maliit"),
}
_PHRASES = ("great quality and nice color but the price is poor for me", "ok", "the courier was fast and the parcel came early today", "maganda ang tunog ng battery at sulit ang presyo", "sira agad at pangit ang material kaya sayang ang pera", "")


def _hit(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"regexp_matches(t, '(^|[^a-zà-ž0-9]){w}($|[^a-zà-ž0-9])')::INT" for w in words) + ")"


_D = T.DEFAULT
_LADDER = f""", ph AS (SELECT review_id, product_id, star_rating, lower(trim({sql_picked(_PHRASES)})) AS t FROM reviews), hs AS (SELECT *, len(regexp_extract_all(t, '[a-zà-ž0-9]+'))::INT AS tokens, {_hit(_D.positive)} AS pos, {_hit(_D.negative)} AS neg, {_hit(_D.delivery)} AS dl, {_hit(_D.product)} AS pr,
  list_bool_or(list_transform({list(_D.generic)!r}, lambda g: t = g OR t = g || '!' OR (len(regexp_extract_all(t, '[a-zà-ž0-9]+')) <= 6 AND contains(t, g)))) AS gen FROM ph),
cl AS (SELECT *, CASE WHEN t = '' THEN 'unavailable' WHEN tokens <= 4 OR length(t) < 24 OR gen THEN 'liv' WHEN dl > 0 AND pr = 0 AND tokens < 18 THEN 'irrelevant' WHEN (star_rating >= 4 AND neg > pos) OR (star_rating <= 2 AND pos > neg) THEN 'deceptive' ELSE 'authentic' END AS label,
  CASE WHEN t = '' THEN NULL WHEN pos = neg THEN 'neutral' WHEN pos > neg THEN 'positive' ELSE 'negative' END AS sentiment FROM hs)"""


def _analysed(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = r.select("review_id", "product_id", F.col("star_rating").alias("rating"), picked(_PHRASES).alias("t"))
    c = rows.withColumn("c", T.classify(F.col("t"), F.col("rating"), T.DEFAULT)).select("review_id", "product_id", "rating", "t", "c.label", "c.sentiment")
    topics = F.array_compact(F.array(*[F.when(T.word_hits(F.lower("t"), w) > 0, F.struct(F.lit(k).alias("topic"), F.lit(i).alias("place"))) for i, (k, w) in enumerate(TOPICS.items())]))
    return panels.local_analysis(c, rows.select("review_id", F.explode(topics).alias("x")).select("review_id", "x.*"), "product_id", 2)


@on_reviews("ladder_labels", _LADDER + " SELECT review_id, label, sentiment, tokens, pos, neg FROM cl")
def ladder_labels(r: DataFrame) -> DataFrame:
    """The classifier with its own words and limits, over phrases that reach every rule."""
    return r.select("review_id", T.classify(picked(_PHRASES), F.col("star_rating"), T.DEFAULT).alias("c")).select("review_id", "c.*")


@on_reviews("local_counts", _LADDER + """ SELECT product_id, count(*) FILTER (label = 'authentic') AS authentic, count(*) FILTER (label = 'liv') AS liv, count(*) FILTER (label = 'irrelevant') AS irrelevant, count(*) FILTER (label = 'deceptive') AS deceptive, count(*) FILTER (label = 'authentic' AND sentiment = 'positive') AS positive, count(*) FILTER (label = 'authentic' AND sentiment = 'neutral') AS neutral, count(*) FILTER (label = 'authentic' AND sentiment = 'negative') AS negative,
    CASE WHEN count(*) FILTER (label <> 'unavailable') = 0 THEN 0 ELSE floor(100.0 * count(*) FILTER (label = 'authentic') / count(*) FILTER (label <> 'unavailable') + 0.5) END::INT AS authentic_share, round(avg(star_rating) FILTER (label = 'authentic'), 9) AS verified_rating FROM cl GROUP BY 1""")
def local_counts(r: DataFrame) -> DataFrame:
    return _analysed(r)[0]


_TOPIC_SQL = " UNION ALL ".join(f"SELECT product_id, sentiment, '{k}' AS topic, {i} AS place FROM cl WHERE label = 'authentic' AND {_hit(w)} > 0" for i, (k, w) in enumerate(TOPICS.items()))


@on_reviews("local_topics", _LADDER + f", tp AS ({_TOPIC_SQL}), ag AS (SELECT product_id, topic, place, count(*) AS mentions, floor(100.0 * count(*) FILTER (sentiment = 'positive') / count(*) + 0.5)::INT AS positive_percent FROM tp GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, place)::INT AS rank FROM ag) SELECT product_id, rank, topic, mentions, positive_percent FROM rk WHERE rank <= 2")
def local_topics(r: DataFrame) -> DataFrame:
    return _analysed(r)[1]
