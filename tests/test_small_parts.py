"""Deep pages, single texts, row weights, gains and what may be published."""

import json

import pytest
from pyspark.sql import functions as F

from reviewspark.operators import fill, reports, views
from reviewspark.plans import batch


def test_deep_pages_have_the_places_of_the_whole_order(spark, monkeypatch):
    rows = [(i, (i * 7) % 6 if i % 11 else None, "x" * ((i * 5) % 13)) for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, star_rating int, review_text string")
    valid = lambda r: r[1] is not None and 1 <= r[1] <= 5
    whole = {
        "lowest": sorted(rows, key=lambda r: (not valid(r), r[1] is not None, r[1] or 0, r[0])),
        "longest": sorted(rows, key=lambda r: (-len(r[2]), r[0])),
    }
    for top in (views.TOP, 0):
        monkeypatch.setattr(views, "TOP", top)
        for order, want in whole.items():
            for n in (0, 3, 6, 9):
                got = views.page(df, order, n).orderBy("place").collect()
                assert [(r.place, r.doc_id) for r in got] == [(k + 1, want[k][0]) for k in range(20 * n, min(20 * n + 20, len(want)))]
                assert not got or set(got[0].asDict()) == {"doc_id", "star_rating", "review_text", "place"}


def test_one_text(spark):
    seen = []

    def find(rows):
        seen.append(rows.first().asDict())
        return rows.select("review_id", F.lit(3).alias("aspect"), F.lit(2).alias("sentiment"))

    (pair,) = batch.predict_text(spark, "  fine lid ", "https://a/1.jpg| ", find)
    assert pair["sentiment"] == "Positive" and set(pair) == {"category", "sentiment"}
    assert seen == [{"review_id": "manual_review", "review_text": "fine lid", "image_urls": ["https://a/1.jpg"]}]
    with pytest.raises(ValueError, match="blank"):
        batch.predict_text(spark, " \n", "", find)


def test_row_weights_move_a_classifier(spark):
    rows = [("good thing", 0, 1.0), ("good thing", 1, 9.0)] * 6 + [("other words", 0, 1.0)] * 6
    df = spark.createDataFrame(rows, "review_text string, label int, w double")
    chance = lambda **k: batch.text_classifier("label", 64, 20, **k)(df)(df.where("review_text = 'good thing'")).first()["probabilities"][1]
    assert chance(weight="w") > 0.75 > chance()


def test_gains(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 3)], "a int, b int")
    targets, lack = fill.gains(F.col("a"), F.col("b"), {1: 7, 2: 0}, {1: 8, 0: -2})
    assert [tuple(r) for r in df.select(targets, lack).collect()] == [(2, 15), (1, 7), (0, 0)]


def test_publication(spark):
    frame = spark.createDataFrame
    reviews = lambda *more: frame([(f"r{i:02}", "test", "authentic", "liv", f"secret {i}") for i in range(30)] + list(more), "id string, partition string, ground_truth string, label string, text string")
    whole = [(a, p, float(a == p)) for a in range(4) for p in range(4)]
    cells = lambda rows: frame(rows, "actual int, pred int, n double")
    value = frame([(0.5,)], "value double")
    got = reports.publication(reviews(), cells(whole), value).first()
    samples = json.loads(got["samples"])
    assert got["comparisons"] == 30 and len(samples) == 20 and samples[0] == {"id": "r00", "ground_truth": "authentic", "label": "liv", "correct": False}
    assert "secret" not in got["samples"] and got["source_sha256"] == reports.publication(reviews().orderBy(F.desc("id")), cells(whole), value).first()["source_sha256"]
    problems = reports.matrix_problems(cells([*whole[1:], whole[5], (4, 0, 1.0), (0, 1, 1.5), (None, 0, 1.0), (2, 2, -1.0)])).first().asDict()
    assert problems == {"missing_cells": 1, "repeated_cells": 3, "other_cells": 2, "bad_counts": 2}
    for bad, what in ((reviews(("r99", "train", "liv", "liv", "")), "not_test"), (reviews(("r01", "test", "liv", "liv", "")), "repeated"), (reviews(("r99", "test", "odd", "liv", "")), "unknown_label")):
        with pytest.raises(ValueError, match=what):
            reports.publication(bad, cells(whole), value)
    with pytest.raises(ValueError, match="missing"):
        reports.publication(reviews(), cells(whole[1:]), value)
