"""Scores of language, quality and neighbours against plain versions, and the pipeline on planted cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewspark.llm import ann, langid, quality

RNG = random.Random(23)
LETTERS = {"xx": "abcdefghij", "yy": "ghijklmnop"}


def words(lang, n, gen=RNG):
    return " ".join("".join(gen.choices(LETTERS[lang], k=gen.randint(2, 7))) for _ in range(n))


def plain_cost(counts, text):
    """Code length of a text under counts of byte contexts, one byte after the other."""
    data, bits = langid.PAD + text, 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            ctx, sym = data[i - k : i], data[i]
            seen = counts[k].get(ctx)
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if sym in seen:
                bits += math.log2((n + kinds) / seen[sym])
                break
            bits += math.log2((n + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_against_a_byte_by_byte_version(spark):
    learn = [(i, lang, words(lang, 30)) for i, lang in enumerate(["xx", "yy"] * 10)]
    model = langid.train(spark.createDataFrame(learn, "doc_id long, lang string, text string"), docs_per_language=10**6)
    trees = {}
    for lang in LETTERS:
        counts = {k: defaultdict(Counter) for k in range(4)}
        for _, of, text in learn:
            data = langid.PAD + text.encode()
            if of == lang:
                for i in range(3, len(data)):
                    for k in range(4):
                        counts[k][data[i - k : i]][data[i]] += 1
        trees[lang] = counts
    texts = [words("xx", 12), words("yy", 12), "zz ünï 9", "a", words("xx", 3000)]
    got = model.score([t.encode() for t in texts], model.rows())
    for row, t in zip(got, texts, strict=True):
        for at, lang in enumerate(model.langs):
            assert row[at] == pytest.approx(plain_cost(trees[lang], t.encode()), rel=1e-4)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert out[0].lang_pred == "xx" and out[1].lang_pred == "yy" and out[4].lang_pred == "xx"
    gap = got[0][1] - got[0][0]
    assert out[0].score == pytest.approx(1 / (1 + 2.0**-gap), abs=1e-6)


def test_quality_scores_against_a_plain_sum(spark):
    gen = random.Random(4)
    vocabulary = ["".join(gen.choices("abcdefghijklmnop", k=gen.randint(3, 9))) for _ in range(300)]
    good = [" ".join(gen.choices(vocabulary, k=40)) for _ in range(60)]
    bad = [" ".join(gen.choices(vocabulary[:20], k=20) + ["idiot", "scum"] * 3) + " !!!!" for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(100)], "doc_id long, quality int, toxic int")
    scorer = quality.train(docs, labels)
    tests = [*good[:3], *bad[:3], "", "One LINE\n" * 50]

    def plain(t):
        raw, found = t.encode(), set()
        for w in _pieces(raw.lower()):
            found.add(quality._hash_of(w))
            if len(w) > quality.STEM:
                found.add(int((_mixed(w[: quality.STEM])) % quality.BUCKETS))
        for j, (x, cuts) in enumerate(zip(quality.statistics(raw), quality._CUTS, strict=True)):
            found.add(quality.BUCKETS + j * quality.LEVELS + sum(x > c for c in cuts))
        return 1 / (1 + math.exp(-(scorer.bias + sum(scorer.weights[f] for f in found))))

    assert scorer.bad([t.encode() for t in tests]) == pytest.approx([plain(t) for t in tests], abs=1e-9)
    got = {r.doc_id: r.accepted for r in quality.score(docs, scorer).collect()}
    assert sum(got[i] for i in range(60)) >= 58 and not any(got[i] for i in range(60, 100))


def _pieces(raw):
    out, now = [], b""
    for b in raw:
        if quality._WORD[b]:
            now += bytes([b])
        elif now:
            out.append(now)
            now = b""
    return [*out, now] if now else out


def _mixed(piece):
    d = np.frombuffer(piece, np.uint8)
    h = quality.span_hash(quality.prefix_hash(d, quality._VALUES), np.array([0]), np.array([len(d)]))
    return int(quality.mix(h + np.uint64(7))[0])


def test_neighbours_of_small_tables_are_exact(spark):
    """With fewer vectors than a query needs, all are compared; distances and ties as in a plain sort."""
    gen = np.random.default_rng(9)
    rows = [(i, gen.normal(size=16).astype(np.float32).tolist()) for i in range(9)] + [(100, [1.0] + [0.0] * 15), (101, [1.0] + [0.0] * 15), (200, [0.1] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q, v in rows:
        if q % 100 == 0:
            want = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, x in rows if i != q)[:10]
            assert [i for _, i in got[q]] == [i for _, i in want] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in want])


def test_recall_with_the_registered_setting(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        truth |= {(int(ids[i]), int(ids[j])) for j in [j for j in np.lexsort([ids, d]) if j != i][:10]}
    got = {(r.query_id, r.vec_id) for r in ann.op7_ann(spark, sf).collect()}
    assert len(got & truth) >= 0.9 * len(truth)


def test_pipeline_on_planted_cases(spark, tmp_path):
    """Copies, near copies, shared passages and insults are caught; clean documents stay as they are, whatever the columns hold."""
    gen = random.Random(6)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    clean = [r for r in base.join(labels.where("quality = 1 and toxic = 0"), "doc_id").where("lang = 'en' and length(text) between 600 and 3000").select("doc_id", "text").orderBy("doc_id").collect()]
    vocabulary = sorted({w for r in clean for w in r.text.split()})
    prose = lambda n: " ".join(gen.choices(vocabulary, k=n))
    passage = prose(60)
    one, two = prose(150), prose(200)
    near = two.split()
    near[50] = "changed"
    planted = {9001: one, 9002: one, 9003: two, 9004: " ".join(near), 9005: f"{prose(80)} {passage} {prose(80)}", 9006: f"{passage} {prose(120)}", 9007: prose(150), 9008: None, 9009: "", 9010: prose(150)}
    rows = [(k, t, None if k == 9007 else "en", "s", None, "extra", "extra") for k, t in planted.items()]
    rows += [(9010, planted[9010], "en", "s", None, "extra", "extra"), (None, prose(100), None, None, None, None, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, block string")
    docs = base.withColumns({"key": F.lit("k"), "block": F.lit("b")}).unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).checkpoint()
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    left = seen["repeats"]
    assert {9001, 9003, 9005, 9006, 9007, 9010} <= set(left) and not {9002, 9004} & set(left)
    assert set(seen["language"]) - set(seen["near_duplicates"]) >= {9002, 9004}
    assert passage not in left[9005] and passage not in left[9006] and left[9007] == planted[9007]
    packed = corpus_pipeline.packing_stage(spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)


def test_suffix_query_on_whole_texts(spark, tmp_path):
    from reviewspark.llm import queries

    passage, long_ = words("xx", 56), words("yy", 120)
    texts = [f"{words('xx', 40)} {passage} {words('yy', 9)}", f"{passage} {words('yy', 60)}", f"{words('xx', 9)} {long_}", long_, long_, None, "", words("xx", 150)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)] + [(None, words("yy", 5), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op9_suffix"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    starts = Counter(t[i : i + 400] for t in (r[1] or "" for r in rows) for i in range(len(t) - 399))
    for i, t in ((r[0], r[1] or "") for r in rows):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if starts[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        assert (got[i].n_bytes, got[i].n_removed) == (len(t), int(gone.sum()))
        assert got[i].n_repeated_words == {0: 56, 1: 56, 2: 120, 3: 120, 4: 120}.get(i, 0)
