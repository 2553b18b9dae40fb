"""Hand-computed cases of the review operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from reviewspark.functions import contract as C
from reviewspark.functions import text as T
from reviewspark.operators import ablation, augment, graph, metrics, splits, summary, views, weights
from reviewspark.sources import reviews as S


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_labels(spark):
    assert column(spark, ["vague", " Authentic", "2.0", "3", "1.5", "nan", None, "-1", "low-value"], "string", C.map_quality) == [2, 0, 2, 3, None, None, None, None, 2]


def test_ratings(spark):
    assert column(spark, ["1", "5", None, "", "NaN", "0", "6", "2.5"], "string", C.normalize_rating) == [0, 1, None, None, None, None, None, None]


def test_image_urls(spark):
    assert column(spark, ['["a", "b", "a"]', "a | b", "[3]", None], "string", C.parse_image_urls) == [["a", "b"], ["a", "b"], None, []]


def test_annotations(spark):
    raw = '[{"category":"performance","text":"x","sentiment":"Positive"},{"category":"performance","text":"y","sentiment":"negative"}]'
    got = column(spark, [raw, '[{"category":"delivery","text":"x","sentiment":"Positive"}]', "[]", None], "string", C.parse_annotations)
    assert [(x.category, x.sentiment, x.evidence) for x in got[0]] == [("performance", 0, ["y"]), ("performance", 2, ["x"])]
    assert got[1:] == [None, [], None]


def test_polarity_selection(spark):
    assert column(spark, [[0.8, 0.1, 0.7], [0.1, 0.2, 0.15]], "array<double>", lambda c: C.sentiment_selected(c, 0.5)) == [[0, 2], [1]]


def test_segments(spark):
    text = "The lid fits well. It leaks but the seller sent another one | cheap, blue, small, round; loud"
    got = column(spark, [text, "\n one line only \n", "..."], "string", T.evidence_segments)
    assert got[0] == ["The lid fits well.", "It leaks", "but the seller sent another one |", "cheap, blue, small, round;", "loud"]
    assert got[1:] == [["one line only"], ["..."]]
    long_ = " ".join(f"w{i}," if i == 9 else f"w{i}" for i in range(22))
    assert [len(x.split()) for x in column(spark, [long_], "string", T.evidence_segments)[0]] == [10, 12]


def test_heuristic(spark):
    got = column(spark, ["ok", "the parcel arrived with the courier very quickly", "this is a really bad and broken product, do not buy", None], "string", lambda c: T.classify(c, F.lit(5), T.DEFAULT)["label"])
    assert got == ["liv", "irrelevant", "deceptive", "unavailable"]


def test_product_sentiment(spark):
    r = spark.createDataFrame([("r1", "a", 0, 5), ("r2", "b", 1, 1)], "review_id string, product_id string, label int, star_rating int")
    p = spark.createDataFrame([("r1", 2, 0), ("r1", 3, 1), ("r2", 2, 0)], "review_id string, aspect int, sentiment int")
    got = {x.product_id: (x.review_count, x.sentiment) for x in summary.product_sentiment(r, p).collect()}
    assert got == {"a": (1, -0.5), "b": (1, None)}
    o = summary.overall(r, p).first()
    assert (o.verified_rating, o.sentiment, o.authentic_share) == (5, -0.5, 50)
    assert summary.overall(r.limit(0), p.limit(0)).first().authentic_share == 0


def _ablation(spark, reviews, gold, pred):
    r = spark.createDataFrame(reviews, "review_id string, product_id string, truth int, pred int")
    g, p = (spark.createDataFrame(x, "review_id string, aspect int, sentiment int") for x in (gold, pred))
    return ablation.aspect_pairs(r, g, p)


def test_ablation_distinct_polarity(spark):
    pairs = _ablation(spark, [("r1", "p", 0, 0), ("r2", "p", 0, 0)], [("r1", 2, 2), ("r1", 2, 0), ("r1", 2, 2), ("r2", 2, 2)], [("r1", 2, 2), ("r2", 2, 0)])
    x = pairs.where("aspect = 2").first()
    assert (x.truth_score, x.filtered, x.filtered_error, pairs.count()) == (0.5, 0, 0.5, 10)


def test_ablation_missing_and_ungated(spark):
    x = _ablation(spark, [("r1", "p", 0, 2)], [("r1", 2, 2)], [("r1", 2, 2)])
    row = x.where("aspect = 2").first()
    assert (row.reasons, row.eligible) == ("no_filtered_prediction", False)
    assert ablation.overall(x).first().pooled_filtered is None
    y = _ablation(spark, [("r1", "p", 0, 0), ("r2", "p", 1, 1)], [("r1", 2, 2)], [("r1", 2, 2), ("r2", 2, 0)]).where("aspect = 2").first()
    assert (y.truth_score, y.unfiltered, y.improvement) == (1, 0, 1)


def test_class_metrics_keep_empty_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "actual int, pred int")
    m = {r.label: r for r in metrics.class_metrics(df).collect()}
    assert (m[0].support, m[0].precision, round(m[0].recall, 6), m[3].f1) == (3, 1, 0.666667, 0)


def test_weights(spark):
    rows = [("k", 3, "k"), ("k1", 3, "k"), ("l", 3, "l"), ("m", 2, "m"), ("m1", 2, "m"), ("m2", 2, "m"), ("n", 1, "n"), ("o", 0, "o"), ("o1", 0, "o"), ("p", 0, "p")]
    df = spark.createDataFrame(rows, "id string, label int, family string")
    w = {r.id: r.weight for r in weights.source_class_balanced(df).collect()}
    of = lambda f: sum(v for k, v in w.items() if k.startswith(f))
    assert of("k") == pytest.approx(of("l")) == pytest.approx(1.25) and of("m") == pytest.approx(of("n")) == pytest.approx(2.5) and sum(w.values()) == pytest.approx(10)
    s = {r.id: r.weight for r in weights.source_balanced(df).collect()}
    assert s["m"] == pytest.approx(10 / (6 * 3)) and sum(s.values()) == pytest.approx(10)
    assert {r.id: r.weight for r in weights.row_balanced(df).collect()}["n"] == pytest.approx(10 / 4)
    broken = df.withColumns({"product": F.lit("p"), "original": F.col("id") == F.col("family")}).withColumn("label", F.when(F.col("id") == "o1", 2).otherwise(F.col("label"))).where("id <> 'n'")
    assert weights.family_violations(broken).first().asDict() == {"labels_differ": 1, "products_differ": 0, "without_original": 0}


def test_transitive_split(spark):
    rows = [("r0", "p0", "one"), ("r1", "p1", "ONE"), ("r2", "p2", "two"), ("r3", "p3", " two "), ("r4", "p1", "three"), ("r5", "p2", "three"), ("r6", "p9", "four")]
    r = spark.createDataFrame(rows, "review_id string, product_id string, review_text string")
    assert {x.product_id: x.component for x in splits.product_components(r).collect()} == {"p0": "p0", "p1": "p0", "p2": "p0", "p3": "p0", "p9": "p9"}
    whole = r.select("review_id", "product_id", F.when(F.col("product_id") == "p9", "test").otherwise("train").alias("partition"), F.when(F.col("product_id") == "p9", -1).otherwise(0).alias("fold"))
    found = lambda split: {x.rule: x.n for x in splits.violations(r, split).collect() if x.n}
    assert found(whole) == {"empty_partition": 1, "empty_fold": 4}
    moved = whole.withColumn("partition", F.when(F.col("review_id") == "r0", "validation").otherwise(F.col("partition")))
    assert found(moved) == {"fold_range": 1, "text_partition": 1, "empty_fold": 4}


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100)], "src long, dst long")
    got = {x.node: x.component for x in graph.connected_components(chain).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 42
    assert graph.connected_components(chain.limit(0)).count() == 0


def test_sort_orders(spark):
    rows = [("a", 3, "xxx", 0), ("b", None, "xxxxx", 1), ("c", 1, "x", 2), ("d", 5, "xxxxxx", 3), ("e", 3, "xx", 4)]
    r = spark.createDataFrame(rows, "review_id string, star_rating int, review_text string, doc_id int")
    order = lambda o: "".join(x.review_id for x in views.ordered(r, o).collect())
    assert (order("lowest"), order("highest"), order("original")) == ("caedb", "daecb", "abcde")


def test_quality_gain():
    final, text = {0: 10, 1: 2, 2: 10, 3: 10}, {0: 10, 1: 3, 2: 10, 3: 10}
    assert [augment.quality_gain(final, text, 10, p) for p in ((1, 1), (1, 0))] == [(2, 15), (1, 8)]


def test_requests(spark):
    good = '{"schemaVersion":"1.0","platform":"shopee","reviews":[{"id":"1","text":"fine","rating":5}]}'
    bad = '{"platform":"other","extra":1,"reviews":[{"id":"1","text":"","rating":9},{"id":"1","text":"x","rating":1}]}'
    got = [r.problems for r in S.read_requests(spark.createDataFrame([(good,), (bad,), ("nothing",)], "body string")).collect()]
    assert got[0] == [] and set(got[1]) == {"unknown_field", "platform", "text_length", "rating", "duplicate_id"} and "not_json" in got[2]


def test_csv_keeps_ids_and_names_problems(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿review_id,product_id,product_title,review_text,review_image_urls,star_rating,text_label,ground_truth\n007,p,t,good,,5,authentic,0\n007,p,t,,[3],9,x,0\n")
    rows = S.read_reviews(spark, str(path)).orderBy(F.desc("review_text")).collect()
    assert rows[0].review_id == "007" and rows[0].problems == ["duplicate_id"]
    assert rows[1].problems == ["duplicate_id", "blank_text", "bad_label", "bad_rating", "bad_image_list"]


def test_draft_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        augment.check_columns(spark.createDataFrame([("x",)], "review_id string"))
