"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import base64
import hashlib
import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from reviewspark.llm import ann, bpe, langid, maxent, minhash, packing, quality, simhash, suffix, warc
from reviewspark.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp0 string"
RNG = random.Random(3)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n)).capitalize() + "."


@cache
def awkward():
    """Nulls in every column, empty and very long texts, ties, repeated rows, more columns with names used within."""
    base = prose(300)
    texts = [None, "", " \n", "!!", "Ünïcödé 😀 ΣΑΣ x y", base, base, base + " more", base.upper(), prose(40_000), "x" * 50_000, prose(3), prose(5) + "\n\n\t" + prose(80)]
    rows = [(i, t, "aa" if i % 3 else None, "s", None, "k", "f") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id at all " * 20, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(awkward(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_documents(rows, P.path("word_bpe_49k.json"), group_docs=4).collect()
    want = []
    for doc_id, text, *_ in awkward():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(doc_id, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(s)]).tolist()]
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= 4096
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0


def test_first_fit_against_scan():
    for seed in range(20):
        lengths = sorted(random.Random(seed).choices(range(1, 101), k=60), reverse=True)
        free, want = [], []
        for n in lengths:
            i = next((i for i, f in enumerate(free) if f >= n), len(free))
            if i == len(free):
                free.append(100)
            want.append((i, 100 - free[i]))
            free[i] -= n
        assert list(zip(*packing.first_fit(lengths, 100), strict=True)) == want


def test_language_id(spark, rows, none):
    got = Q.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n >= 20 and right >= 0.9
    model = langid.train(rows)
    out = langid.predict(rows, model).collect()
    assert len(out) == len(awkward()) and {r.lang_pred for r in out if r.doc_id in (0, 1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert langid.predict(rows, langid.train(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, model).count() == 0


def test_code_length_of_small_tree():
    """'ab' twice: after an empty context a and b are known once each per text."""
    tree = langid.ContextTree(*np.unique(langid.grams(b"ab"), return_counts=True))
    known, fresh = tree.cost(langid.grams(b"ab")), tree.cost(langid.grams(b"z"))
    assert known.tolist() == [1.0, 1.0]  # one symbol of one kind: 1/(1+1)
    assert fresh[0] == pytest.approx(1 + 1 + 1 + 1 + 8)  # escapes from 3, 2, 1 and 0 bytes, then a byte


def test_maxent(spark, rows, none):
    docs = rows.withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)))
    got = maxent.score_documents(docs).collect()
    split = lambda t: [*bytes(t or "", "utf-8").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split(), None]
    count = {}
    for doc_id, text, *_ in awkward():
        if doc_id is None or doc_id % 4:
            for w in split(text):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    text_of = {r[0]: r[1] for r in awkward()}
    assert len(got) == len(awkward())
    for r in got:
        words = split(text_of[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in count for w in words), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    assert maxent.score_documents(none.withColumn("held_out", F.lit(False))).count() == 0


def test_maxent_beats_unigrams_and_sums_to_one(spark):
    got = Q.op3_lm_score(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
    m = maxent.Model([(i, 50 - i) for i in range(30)], 2000, 90)
    m.class_rows += np.random.default_rng(1).normal(size=m.class_rows.shape).astype(np.float32)
    e = np.arange(maxent.VOCABULARY, dtype=np.uint64)
    unseen = -0.1 * np.ones(len(e)) + m.n_other + 0.1 * (m.v_other + 1)  # all other words together
    assert (10 ** m.log10(e, unseen)).sum() == pytest.approx(1, abs=1e-3)


def test_quality(spark, rows, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = quality.score(docs, quality.train(docs, labels.where(even))).join(labels.where(~even), "doc_id")
    share = lambda which: got.where(which).agg(F.avg(F.col("accepted").cast("int"))).first()[0]
    assert share("quality = 1 and toxic = 0") >= 0.95 and share("quality = 0") <= 0.1 and share("toxic = 1") <= 0.1
    scorer = quality.train(docs, labels)
    out = quality.score(rows, scorer).collect()
    assert len(out) == len(awkward()) and all(0 <= r.quality_score <= 1 for r in out)
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert quality.score(rows, quality.train(rows, None)).count() == len(awkward())


def test_expectation_maximisation_finds_the_poor_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    votes = np.stack([np.where(rng.random(3000) < a, truth, ~truth) for a in (0.95, 0.9, 0.9, 0.5)], 1).astype(np.int8)
    p, rates = quality.expectation_maximisation(votes)
    assert ((p > 0.5) == truth).mean() > 0.95 and rates[0, 0] - rates[0, 1] > 0.8 and abs(rates[3, 0] - rates[3, 1]) < 0.1


def test_fingerprints(spark, rows, none):
    got = {r.doc_id: r for r in minhash.edited_fingerprints(rows).collect()}
    data = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, (doc_id, text, *_) in enumerate(data):
        if doc_id == 5:  # a repeated row has two edited texts
            continue
        t, nxt = text or "", data[(i + 1) % len(data)][1] or ""
        want = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[doc_id].n_chars, got[doc_id].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1 and got[9].near_next < 0.2
    assert minhash.edited_fingerprints(none).count() == 0


def test_fingerprints_estimate_jaccard():
    a = prose(400).encode()
    words = a.split()
    for cut in (0.1, 0.3, 0.6):
        b = b" ".join(words[: int(400 * (1 - cut))] + prose(int(400 * cut)).encode().split())
        x, y = (set(minhash.shingle_hashes([t])[0].tolist()) for t in (a, b))
        estimate = minhash.likeness(minhash.fingerprints([a]), minhash.fingerprints([b]))[0]
        assert estimate == pytest.approx(len(x & y) / len(x | y), abs=0.15)


def test_near_duplicates(spark, rows, none):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(rows).collect()}
    assert got[5] == got[6] == got[7] == got[8] == 5 and got[9] == 9 and got[0] == got[1] == 0
    assert minhash.near_duplicates(none).count() == 0


def test_warc(spark, tmp_path):
    pages = [(3, "u", "same"), (1, "v", "same"), (2, None, None), (5, "w", ""), (4, "x", "Ünï😀" * 9000), (None, "y", "no id"), (7, "z", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, kind int")
    out = []
    for name in ("a", "b"):
        folder = f"file://{tmp_path}/{name}"
        warc.write(df, folder, roll_bytes=1000)
        out.append({p.name: p.read_bytes() for p in (tmp_path / name).glob("*.warc.gz")})
        got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert out[0] == out[1] and len(out[0]) >= 2 and len(got) == len(pages)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        first = min(k for k, _, h in pages if k is not None and (h or "") == (html or "")) if page_id is not None else None
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == first else ("revisit", first))
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    warc.write(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_query_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    key = lambda r: r[0]
    assert sorted(map(tuple, Q.op6_warc(spark, SF).collect()), key=key) == sorted(c.execute(Q.SQL["op6_warc"]).fetchall(), key=key)


def exact(vectors, k):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    return {q: sorted((float(np.sqrt(((x - ok[q]) ** 2).sum())), i) for i, x in ok.items() if i != q)[:k] for q in ok if q % 100 == 0}


def test_ann_on_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(30)] + [(300, None), (301, [0.0] * 8), (302, [None] + [1.0] * 7), (303, [float("nan")] * 8), (400, []), (None, [1.0] * 8), vectors[3]]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, ids string")
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = exact(vectors, 10)
    assert got.keys() == want.keys() and [v for _, v in got[0]] == list(range(200, 210))
    assert all(len(v) == 10 and v == sorted(v) for v in got.values())
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_recall(spark):
    rows_ = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = exact(rows_, 10), Q.op7_ann(spark, "/root/testdata/sf0.01").collect()
    truth = {(q, v) for q, near in want.items() for _, v in near}
    assert len({(r.query_id, r.vec_id) for r in got} & truth) >= 0.9 * len(truth)


def naive_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if label[a] != label[b] and linked(a, b):
                x, y = sorted((label[a], label[b]))
                label = [x if z == y else z for z in label]
    return label


def test_simhash(spark, rows, none):
    more = [*awkward()] + [(100 + i, " ".join((w := prose(60).split())[:60]) + (" tail" * (i % 2)), *[None] * 5) for i in range(60)]
    more += [(200 + i, more[20 + i][1] + " x", *[None] * 5) for i in range(40)]
    got = {r.doc_id: r for r in simhash.components(spark.createDataFrame(more, SCHEMA)).collect()}
    docs = sorted({r[0]: r for r in more if r[0] is not None}.values())
    fps = [naive_fingerprint(r[1]) for r in docs]
    label = reach(len(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    for i, d in enumerate(docs):
        assert (got[d[0]].fp0 % 2**64, got[d[0]].component) == (fps[i], docs[label[i]][0])
    assert simhash.components(none).count() == 0


def naive_removal(texts, length):
    starts = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            starts.setdefault(t[i : i + length], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in starts.values():
        for d, i in where if len(where) > 1 else []:
            gone[d][i : i + length] = True
    return [(len(t), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~g])) for t, g in zip(texts, gone, strict=True)]


@pytest.mark.parametrize("length", [120, 400])
def test_suffix(spark, none, length):
    passage, other = prose(90), prose(120)
    texts = [None, "", "ab" * 700, "z" * 3000, prose(200) + passage + prose(50), passage[7:] + prose(90), prose(40) + other, other, other, other[: length - 1], prose(60) + "Ü" * 500 + passage[:410], (prose(30) + " ") * 30]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, block string")
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df, ["doc_id"], length).orderBy("doc_id").collect()]
    assert got == naive_removal([(t or "").encode() for t in texts], length)
    assert suffix.remove_repeats(none, ["doc_id"], length).count() == 0


def test_merge_takes_all_runs_in_order():
    rng = random.Random(8)
    for _ in range(20):
        runs = [sorted({bytes(rng.choices(b"ab", k=suffix.PREFIX - 90)) + b"c" * 90 for _ in range(rng.randint(1, 40))}) for _ in range(rng.randint(1, 7))]
        coded = [suffix.front_code(np.array([list(s) for s in r], np.uint8)) for r in runs]
        out, last = [], b""
        for run, i, shared in suffix.merge([suffix.Run(same.tobytes(), rest) for same, rest in coded]):
            s = runs[run][i]
            if out:
                assert shared == next((k for k in range(suffix.PREFIX) if s[k] != last[k]), suffix.PREFIX)
            out.append(s)
            last = s
        assert out == sorted(x for r in runs for x in r)


def test_bpe(spark, rows, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    text_of = {r[0]: r[1] for r in awkward()}
    got = bpe.decode(bpe.encode(rows, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(got) == len(awkward())
    for r in got:
        want = np.array(own.encode_ordinary(text_of[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == (len(want), want.tobytes(), (text_of[r.doc_id] or "").encode())
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_pipeline(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and out.count() <= kept.count(), name
        assert stage(spark, none.select(*corpus_pipeline.COLUMNS), SF).count() == 0
        kept = out
    got = corpus_pipeline.run(spark, SF).select("doc_id").distinct()
    assert got.exceptAll(kept.select("doc_id").distinct()).count() == 0 and got.count() == kept.select("doc_id").distinct().count()
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").join(docs, "doc_id")
    first = corpus_pipeline.quality_stage(spark, docs, SF)
    assert clean.join(first.select("doc_id"), "doc_id", "left_semi").count() >= 0.95 * clean.count()
