"""Splits, manifests, evidence, the online plan, pages, files and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewspark.operators import evidence, panels, reports, splits
from reviewspark.plans import batch, online
from reviewspark.sources import files, pages
from reviewspark.sources import reviews as S
from reviewspark.streaming import scans


def some_reviews(spark, products=60):
    """Products with a review of each class; product 3k+1 repeats a text of product 3k."""
    rows = [(f"r{p}-{c}", f"p{p:03d}", f"text {p - (p % 3 == 1)} {c}" if c == 0 else f"own {p} {c}", c) for p in range(products) for c in range(4)]
    return spark.createDataFrame(rows, "review_id string, product_id string, review_text string, label int")


def test_split_search_keeps_every_rule(spark):
    r = some_reviews(spark)
    split = splits.assign(r).checkpoint()
    assert {x.rule for x in splits.violations(r, split).where("n > 0").collect()} == set()
    n = {(x.partition, x.label): x.n for x in split.join(r, "review_id").groupBy("partition", "label").agg(F.count("*").alias("n")).collect()}
    assert len(n) == 12 and abs(sum(v for (p, _), v in n.items() if p == "train") / 240 - 0.7) < 0.05
    shuffled = {(x.review_id, x.partition, x.fold) for x in splits.assign(r.orderBy(F.rand(1)).repartition(7)).select("review_id", "partition", "fold").collect()}
    assert shuffled == {(x.review_id, x.partition, x.fold) for x in split.collect()}
    per_fold = {x.fold: x.n for x in split.where("fold >= 0").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert set(per_fold) == set(range(5)) and max(per_fold.values()) <= 2 * min(per_fold.values())


def test_split_search_fails_where_it_must(spark):
    with pytest.raises(ValueError, match="no split"):
        splits.assign(some_reviews(spark, 6))
    with pytest.raises(ValueError, match="no split"):
        splits.assign(some_reviews(spark).where("label <> 3"))


def test_search_prefers_the_least_deviation():
    rows = np.tile([[1, 1, 1, 1]], (20, 1))
    part = splits.search(rows, np.ones_like(rows), (0.7, 0.15, 0.15), 1)
    assert np.bincount(part).tolist() == [14, 3, 3]
    assert splits.search(rows[:4], np.ones((4, 4)), (0.7, 0.15, 0.15), 1) is None


def test_manifest_of_another_table_or_version_raises(spark, tmp_path):
    r, path = some_reviews(spark), str(tmp_path / "m")
    made = splits.prepare(r, path, "digest")
    again = splits.prepare(r, path, "digest")
    assert sorted(made.collect()) == sorted(again.collect())
    with pytest.raises(ValueError, match="another version or table"):
        splits.prepare(r, path, "other")
    with pytest.raises(ValueError, match="coverage"):
        splits.read_manifest(r.where("review_id <> 'r0-0'"), path, "digest")


def test_evidence_prefers_agreement_then_chance_then_order(spark):
    found = spark.createDataFrame([("a", 1, 0.9, [0.9, 0.1, 0.85]), ("a", 2, 0.3, [0.9, 0.1, 0.1]), ("b", 1, 0.6, [0.2, 0.3, 0.1])], "review_id string, aspect int, score double, p array<double>")
    seg = [("a", 1, 0, "x", 0.5, [0.95, 0.0, 0.1]), ("a", 1, 1, "y", 0.7, [0.9, 0.0, 0.9]), ("a", 1, 2, "z", 0.2, [1.0, 0.0, 1.0]), ("b", 1, 0, "low", 0.1, [0.1, 0.1, 0.1]), ("b", 1, 1, "low too", 0.1, [0.1, 0.9, 0.1]), ("a", 2, 0, "never", 0.9, [0.9, 0.1, 0.1])]
    out = evidence.select_evidence(found, spark.createDataFrame(seg, "review_id string, aspect int, pos int, text string, score double, p array<double>"), 0.4, 0.8)
    assert {(r.review_id, r.aspect, r.sentiment, r.text) for r in out.collect()} == {("a", 1, 0, "x"), ("a", 1, 2, "y"), ("b", 1, 1, "low")}


def test_online_plan_gates_and_summarises(spark):
    seen = []

    def classify(df):
        return df.withColumns({"probabilities": F.when(F.col("review_id") == "b", F.array(*map(F.lit, (0.1, 0.7, 0.1, 0.1)))).otherwise(F.array(*map(F.lit, (0.55555, 0.2, 0.14445, 0.1)))), "similarity": F.lit(None).cast("double"), "best_image": F.lit(None).cast("string")})

    def aspects(own):
        seen.extend(r.review_id for r in own.select("review_id").collect())
        return own.select("review_id", F.explode(F.array(F.struct(F.lit(6).alias("aspect"), F.lit(2).alias("sentiment")), F.struct(F.lit(6).alias("aspect"), F.lit(0).alias("sentiment")))).alias("x")).select("review_id", "x.*")

    df = spark.createDataFrame([("q", 0, "a", 4), ("q", 1, "b", 1), ("z", 0, "c", 5)], "request_id string, pos int, review_id string, star_rating int")
    rows, total = online.run(df, classify, aspects)
    assert sorted(seen) == ["a", "c"]
    got = {r.request_id: r for r in total.collect()}
    q = got["q"]
    assert (q.review_count, q.authentic, q.deceptive, q.liv, q.authentic_share, q.verified_rating, q.negative, q.positive, q.sentiment, q.aspects) == (2, 1, 1, 0, 50.0, 4.0, 1, 1, 0.0, "value:2:50.00")
    assert {r.review_id: (r.confidence, r["class"]) for r in rows.collect()}["a"] == (0.5556, "authentic")


def html_of(card):
    return [(1, f"<html><head><title>A Shop – x</title></head><body>{card}</body></html>")]


def extracted(spark, card, market="shopee"):
    return pages.page_reviews(pages.page_nodes(spark.createDataFrame(html_of(card), "page_id long, html string")), market).collect()


def test_cards_of_a_page(spark):
    card = "<div class='review-item' data-review-id='7'><a href='https://shop.ph/user/ab?x=1'>ab.c</a><div class='rating__rating' aria-label='4.5 out of 5'></div><div class='review-content'>Nice<br>Variation: red<br>works <b>well</b></div><img data-src='https://i/1.png'><img src='/rel.png'><div><p>Seller response: thank you</p></div></div>"
    (r,) = extracted(spark, card)
    assert (r.id, r.username, r.text, r.rating, r.urls, r.seller_replies) == ("shopee-7", "ab.c", "Nice works well", 4.5, ["https://i/1.png"], 1)
    assert extracted(spark, "<p>no review at all</p>") == []


def test_unclosed_and_nested_cards(spark):
    got = extracted(spark, "<div class='review-item' id='o'><div class='review-item' id='i'><p class='review-text'>inner text 2024-01-02</p></div>more words")
    assert [r.id for r in got] == ["shopee-o"]
    stars = "<div class='mod-reviews'><div class='item'><i class='star full'></i><i class='star full'></i><div class='item-content'>fine thing</div></div></div>"
    (r,) = extracted(spark, stars, "lazada")
    assert (r.text, r.rating) == ("fine thing", 2.0)


def test_accepted_reviews_of_a_page(spark):
    rows = [("p", i, f"r{i}", "same" if i < 2 else f"t{i}", 5.0, []) for i in range(25)] + [("p", 30, "blank", "", None, [])]
    df = spark.createDataFrame(rows, "page string, pos int, review_id string, text string, rating double, urls array<string>")
    s = panels.extraction_stats(df, "page").first()
    assert (s.candidates, s.accepted, s.analyzable, s.duplicates, s.without_text) == (26, 20, 20, 1, 0)


def test_tables_with_sidecars(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_with_meta(spark.range(3), path, {"kind": "a"})
    assert files.read_with_meta(spark, path, "id long", {"kind": "a"}).count() == 3
    with pytest.raises(ValueError, match="kind"):
        files.read_with_meta(spark, path, "id long", {"kind": "b"})
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_with_meta(spark.range(1), path, {})


def test_review_csv_through_the_online_plan(spark, tmp_path):
    head = "review_id,product_id,product_title,review_text,review_image_urls,star_rating,text_label,ground_truth\n"
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text(head + "1,p,t,nice thing,,5,authentic,0\n2,p,t,other,,1,liv,2\n")
    bad.write_text(head + "1,p,t,,,5,authentic,0\n")
    given = lambda df: df.withColumns({"probabilities": F.array(*map(F.lit, (0.7, 0.1, 0.1, 0.1))), "label": F.when(F.col("review_id") == "1", 0).otherwise(2), "similarity": F.lit(0.5), "best_image": F.lit("u")})
    none = lambda own: own.select("review_id", F.lit(0).alias("aspect"), F.lit(2).alias("sentiment"))
    s = batch.run_csv(spark, str(good), given, none)[1].first()
    assert (s.review_count, s.authentic, s.liv, s.sentiment, s.verified_rating) == (2, 1, 1, 1.0, 5.0)
    with pytest.raises(ValueError, match="blank_text"):
        batch.run_csv(spark, str(bad), given, none)
    with pytest.raises(ValueError, match="label_stage1"):
        batch.score_aspects(spark.range(1), none, str(tmp_path / "x"), authentic_only=True)


def test_experiment_of_files(spark, tmp_path):
    head = "review_id,product_id,product_title,review_text,review_image_urls,star_rating,text_label,ground_truth,aspect_annotations\n"
    rows = "".join(f"r{p}-{c},p{p:03d},t,own {p} {c},,5,{c},{c},[]\n" for p in range(60) for c in range(4))
    data, manifest = tmp_path / "r.csv", str(tmp_path / "m")
    data.write_text(head + rows)
    reviews = S.read_reviews(spark, str(data), annotations=True)
    splits.write_manifest(splits.assign(reviews), manifest, "d")
    out = files.load_experiment(spark, str(data), manifest, "d")
    assert out.count() == 240
    train = out.where("partition = 'train' and label = 2").first()
    draft = {"review_id": "d", "source_review_id": train.review_id, "review_text": "a new wording", "text_label": "liv", "ground_truth": "2", "aspect_annotations": "[]", "image_mode": "none", "image_source_review_id": "", "augmentation_method": "paraphrase", "review_status": "approved", "reviewed_by": "x", "review_notes": "y"}
    made = lambda **k: spark.createDataFrame([tuple({**draft, **k}.values())], ", ".join(f"{c} string" for c in draft))
    both = files.load_experiment(spark, str(data), manifest, "d", made())
    new = both.where("review_id = 'd'").first()
    assert both.count() == 241 and (new.fold, new.product_id, new.source_review_id) == (train.fold, train.product_id, train.review_id)
    assert files.load_experiment(spark, str(data), manifest, "d", made(review_status="pending")).count() == 240
    with pytest.raises(ValueError, match="text_known"):
        files.load_experiment(spark, str(data), manifest, "d", made(review_text="OWN  1 1"))


def test_markdown_and_best_step(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", None)], "name string, score double")
    assert reports.markdown(df, "name").split("\n") == ["| name | score |", "| - | - |", "| a | – |", "| b | 0.5000 |"]
    h = spark.createDataFrame([("x", 1, 0.4), ("x", 2, 0.6), ("x", 3, 0.6)], "run string, step int, score double")
    assert reports.best_so_far(h, "run").first().step == 2
    assert reports.checkpoint_at(h, h.where("step <> 2"), "run").first().step == 3


def test_streams_of_scans(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "s"), (1, "2024-01-01 00:00:01", "s"), (1, "2024-01-01 00:05:00", "t"), (2, "2024-01-01 00:00:00", "s")]
    df = spark.createDataFrame(rows, "user_id long, ts string, signature string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("quiet", scans.quiet_periods(stream(), "10 seconds")), ("new", scans.changes(stream(), "user_id"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.user_id, r.signature) for r in spark.table("new").collect()} == {(1, "s"), (1, "t"), (2, "s")}
    assert sorted((r.user_id, r.n) for r in scans.quiet_periods(df, "10 seconds").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert all(r.n <= 2 for r in spark.table("quiet").collect())
    last = scans.latest(df, "user_id", "ts").collect()
    assert {(r.user_id, r.signature) for r in last} == {(1, "t"), (2, "s")}


def test_results_are_written_once_and_compared_whole(spark, tmp_path):
    from reviewspark.operators.audit import same_rows

    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    path = str(tmp_path / "once")
    S.write_once(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_once(df, path)
    assert same_rows(df, spark.read.parquet(path).repartition(3)) and not same_rows(df, df.distinct())


def test_bundles_are_assembled_of_equal_cohorts(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "review_id int, side string")
    path = str(tmp_path / "b")
    files.assemble({"text": a, "booster": a.limit(1)}, (a, a.repartition(3)), path, {"version": "1"})
    assert {k: v.count() for k, v in files.read_bundle(spark, path, {"version": "1"}).items()} == {"text": 2, "booster": 1}
    with pytest.raises(ValueError, match="version"):
        files.read_bundle(spark, path, {"version": "2"})
    a.write.mode("append").parquet(f"{path}/text")
    with pytest.raises(ValueError, match="text"):
        files.read_bundle(spark, path, {"version": "1"})
    with pytest.raises(ValueError, match="cohorts"):
        files.assemble({"text": a}, (a, a.limit(1)), str(tmp_path / "c"), {})


def test_paraphrases_keep_evidence_and_move_fields(spark):
    from reviewspark.operators import augment

    rows = [("k", "Size: big | Color: red | Fit: good | the very good thing and more", ["very good", "big"]), ("l", "a good | b | c", ["good | b"]), ("m", "no word here", []), ("n", None, []), ("o", "good", ["gone"])]
    df = spark.createDataFrame(rows, "review_id string, review_text string, parts array<string>")
    got = {r.review_id: r for r in augment.paraphrase(df, {"very good": ["great"], "good": ["fine", "nice"], "and": ["plus"]}, evidence="parts").collect()}
    fields = got["k"].variant.split(" | ")
    assert fields[-1] == "the great thing plus more" and {f.split(":")[0] for f in fields[:-1]} == {"Size", "Color", "Fit"} and got["k"].variant_evidence == ["great", "big"]
    assert got["l"].variant.endswith(" | b | c") and got["m"].variant == "no word here" and got["n"].variant is None
    assert got["o"].variant is None and got["o"].variant_evidence is None
    again = {r.review_id: r.variant for r in augment.paraphrase(df.repartition(4), {"very good": ["great"], "good": ["fine", "nice"], "and": ["plus"]}, evidence="parts").collect()}
    assert again == {k: r.variant for k, r in got.items()}
