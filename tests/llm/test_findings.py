"""The stages and operators against brute force where they once did less than the whole job."""

import random

import numpy as np

import corpus_pipeline
from reviewspark.llm import ann, common, maxent, minhash, packing, simhash, suffix, warc
from reviewspark.operators import graph

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(2, 9))) for _ in range(3000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return RNG.choices(WORDS, k=n)


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def kept_by_brute_force(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {i for i, x in enumerate(label) if x == i}, sets


def test_near_duplicate_stage_against_brute_force(spark):
    texts = []
    for i in range(120):  # a new tail of 5 to 25 % of the words
        words = prose(200)
        cut = 190 - i * 40 // 120
        texts += [" ".join(words), " ".join(words[:cut] + prose(200 - cut))]
    for _ in range(30):  # the same lines over again, a short text and one word more, and no text
        line, short = prose(60), prose(8)
        texts += [" ".join(line), " ".join(line * 5), " ".join(short), " ".join([*short, "more"])]
    texts += [None, "", " \n"]
    kept, sets = kept_by_brute_force(texts)
    pairs = [jaccard(sets[i], sets[i + 1]) for i in range(0, 240, 2)]
    assert sum(0.8 <= p < 0.86 for p in pairs) >= 15 and sum(0.6 <= p < 0.8 for p in pairs) >= 20
    rows = [(i, t, "aa", "s", None) for i, t in enumerate(texts)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([*rows, (None, "no id", None, None, None)], DOCS), "")
    assert {r.doc_id for r in got.collect()} == kept | {None}


def test_near_duplicate_stage_keeps_other_texts_of_an_id(spark):
    a, b, c = " ".join(prose(80)), " ".join(prose(80)), " ".join(prose(80))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (0, c), (2, c), (2, c + " more"), (4, None), (4, a + " more"), (None, a)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS), "")
    want = [(1, a), (2, b), (0, c), (4, None), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_near_duplicate_stage_with_chains_of_false_candidates(spark, monkeypatch):
    """Each text shares three fifths with the next: fingerprints chain them all, shingles none but the planted copies; in small tiles."""
    monkeypatch.setattr(simhash, "TILE", 24)
    monkeypatch.setattr(simhash, "SET_TILE", 7)
    words = prose(120)
    texts = []
    for i in range(90):
        at = 14 * i % 120
        words = [*words[:at], *prose(14), *words[at + 14 :]][:120]
        texts.append(" ".join(words))
    texts += [texts[i] + " more" for i in range(0, 90, 9)]
    kept, _ = kept_by_brute_force(texts)
    assert 70 <= len(kept) < 100
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = simhash.near_copies(df).collect()
    assert {r.doc_id for r in found if r.doc_id == r.component} == kept


def test_repeats_stage_takes_passages_of_51_words(spark):
    texts, want = [], []
    for n in (20, 50, 51, 52, 55, 60, 300):
        for size in (1, 9):  # in bytes such a passage is anything from 101 up
            passage = [w[:size] for w in prose(n)]
            for gap in (" ", "\n"):
                before, after = [prose(RNG.randint(20, 90)) for _ in range(2)]
                texts.append(gap.join([*before, *passage, *after]))
                want.append([*before, *(passage if n < 51 else []), *after])
    twice = " ".join(prose(40) + [w for _ in range(2) for w in texts[20].split()[-60:]])
    texts += [None, "", " \n", twice, "\u00dcn\u00ef \U0001f600 " * 20]
    rows = [(i, t, "aa", "s", None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in corpus_pipeline.repeats_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    naive = removed_by_brute_force([(t or "").split() for t in texts])
    assert len(got) == len(texts) and all(got[i].n_chars == len(got[i].text) for i in got)
    assert [got[i].text.split() for i in range(len(texts))] == naive
    assert [naive[i] for i in range(20)] == want[:20]


def removed_by_brute_force(texts, n=51):
    starts = {}
    for d, words in enumerate(texts):
        for i in range(len(words) - n + 1):
            starts.setdefault(tuple(words[i : i + n]), []).append((d, i))
    gone = {(d, i + k) for where in starts.values() if len(where) > 1 for d, i in where for k in range(n)}
    return [[w for i, w in enumerate(words) if (d, i) not in gone] for d, words in enumerate(texts)]


def test_ann_recall_does_not_depend_on_a_threshold(spark, monkeypatch):
    monkeypatch.setattr(ann, "TWO_HASHES", 0, raising=False)  # a size above which the search used to change
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        truth |= {(int(ids[i]), v) for _, v in sorted((s, int(v)) for s, v in zip(d, ids, strict=True) if v != ids[i])[:10]}
    got = {(r.query_id, r.vec_id) for r in ann.op7_ann(spark, sf).collect()}
    assert len(got & truth) >= 0.9 * len(truth)


def test_maxent_learns_every_position_of_all_documents(spark):
    docs = [(i, " ".join(prose(RNG.randint(1, 14))), i % 5 == 0) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean")
    blocks = maxent.blocks_of(df, ["doc_id", "held_out"], "held_out")
    words = maxent.common_words(maxent.word_counts(blocks))
    learn = [t.split() for _, t, out in docs if not out]
    n = sum(len(t) + 1 for t in learn)
    assert sum(c for _, c in words) == n and len(words) == len({w for t in learn for w in t}) + 1
    got = maxent.train(blocks, maxent.Model(words, n, len(words)), "held_out", rounds=2)
    naive = maxent.Model(words, n, len(words))
    seen = []
    for t in learn:
        h, size = maxent.tokens([" ".join(t).encode()])
        seen += naive.events(h, np.arange(len(h)), size).tolist()
    assert len(seen) == n
    for _ in range(2):  # one position after the other, with plain softmaxes
        g, x = (np.zeros((maxent.ROWS, maxent.CLASSES)) for _ in range(2))
        gp, xp = (np.zeros((maxent.PLACES, maxent.CLASSES)) for _ in range(2))
        for e in np.array(seen, np.uint64):
            y, cr, pr = int(e) & 0xFFFF, [r[0] for r in naive.class_features(e[None])], [r[0] for r in naive.place_features(e[None])]
            for rows, bias, fs, hit, obs, ex in ((naive.class_rows, naive.class_bias, cr, y // 64, g, x), (naive.place_rows, naive.place_bias[y // 64], pr, y % 64, gp, xp)):
                p = np.exp(bias + rows[fs].sum(0))
                for f in fs:
                    obs[f, hit] += 1
                    ex[f] += p / p.sum()
        for rows, a, b, features in ((naive.class_rows, g, x, 3), (naive.place_rows, gp, xp, 2)):
            rows += np.sign(a - b) * np.log1p(np.abs(a - b) / (b + 2.0)) / features
    assert np.allclose(got.class_rows, naive.class_rows, atol=2e-3) and np.allclose(got.place_rows, naive.place_rows, atol=2e-3)


def test_near_duplicates_whose_band_head_is_unlike_them(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BANDS", 1)  # all permutations in one band, which here all texts share
    monkeypatch.setattr(minhash, "signatures", lambda texts: np.zeros((len(texts), minhash.PERMUTATIONS), np.uint32))
    head, a = prose(200), prose(200)
    texts = [head, a, [*a[:190], *prose(10)], [*head[:195], *prose(5)], [*a[:100], *prose(100)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 4}


def test_packing_ids_against_the_tokenizer_on_odd_strings():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.WordIds(path)
    odd = [*"aZbé.,;:!?'0 9ΣσςİıßẞÅK\n\ṫ́  ñ中🙂-_'", " ", " ", "\n", "'s", "'LL", "don't", "ΑΣ", "word", "Word.", "The"]
    strings = ["".join(RNG.choices(odd, k=RNG.randint(1, 9))) for _ in range(60_000)]
    for lo in range(0, len(strings), 2000):
        some = strings[lo : lo + 2000]
        want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(some, add_special_tokens=False)]
        bad = [s for s, a, b in zip(some, own.encode(some), want, strict=True) if a != b]
        assert not bad, bad[:5]


def test_repeated_passages_are_counted_in_words(spark):
    passage = prose(55)
    texts = [" ".join([*prose(30), *passage, *prose(20)]), " ".join([*passage, *prose(70)]), " ".join(prose(200)), None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeated_words for r in suffix.repeated_passages(df, ["doc_id"]).collect()}
    assert got == {0: 55, 1: 55, 2: 0, 3: 0, 4: 0}


def test_range_cuts_follow_the_rows_alone(spark):
    keys = [*range(1000), *[10**15 + i * i for i in range(500)], *[5] * 400, None, -(2**62)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    cuts = common.range_cuts(df, "k", 8)
    assert cuts == common.range_cuts(df.repartition(7), "k", 8) == sorted(set(cuts)) and 4 <= len(cuts) <= 12
    got = df.select("k", common.range_of("k", cuts).alias("p")).collect()
    assert all(r.p == (0 if r.k is None else int(np.searchsorted(cuts, r.k, side="right"))) for r in got)
    sizes = np.bincount([r.p for r in got])
    assert sizes.max() <= 2 * len(keys) / 8 + 400
    assert common.range_cuts(df.limit(0), "k", 8) == [] and common.range_cuts(df, "k", 1) == []


def test_archives_do_not_depend_on_how_rows_are_stored(spark, tmp_path):
    pages = spark.createDataFrame([(i * 7 % 900, f"http://h/{i}", f"page {i % 50} " * 30) for i in range(900)], "page_id long, url string, html string")
    out = []
    for name, df in (("a", pages), ("b", pages.repartition(13))):
        warc.write(df, f"file://{tmp_path}/{name}", roll_bytes=4000, shard_bytes=20_000)
        out.append({p.name: p.read_bytes() for p in (tmp_path / name).glob("*.warc.gz")})
    assert out[0] == out[1] and len(out[0]) > 10


def test_tiles_of_a_hot_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    gen = np.random.default_rng(3)
    base = gen.integers(0, 2**63, 40, dtype=np.uint64) & ~np.uint64(0x1FFF)  # one block is equal: a hot key
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 40), base ^ np.uint64(0b11 << 20), gen.integers(0, 2**63, 60, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(i, int(f.view(np.int64)), 0, 9) for i, f in enumerate(fps)], "node long, fp0 long, fp1 long, size long")
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if int(fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r.node: r.component for r in graph.connected_components(simhash.links(nodes, 4, 5)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == label


def test_tables_too_large_to_send_give_the_same(spark, monkeypatch):
    passage = " ".join(prose(70))
    texts = [" ".join(prose(30)) + " " + (passage if i % 3 == 0 else " ".join(prose(20))) for i in range(40)] + ["", passage, passage]
    df = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], DOCS)

    def found():
        bytes_ = suffix.remove_repeats(df, ["doc_id"], 120).collect()
        return sorted(map(tuple, bytes_)), sorted(map(tuple, corpus_pipeline.repeats_stage(spark, df, "").collect())), sorted(map(tuple, corpus_pipeline.near_duplicate_stage(spark, df, "").collect()))

    sent = found()
    assert any(r[2] for r in sent[0])
    monkeypatch.setattr(suffix, "small", lambda *a: False)
    monkeypatch.setattr(corpus_pipeline, "small", lambda *a: False)
    assert found() == sent


def test_small_counts_bytes_and_rows(spark):
    df = spark.createDataFrame([("abc", None), (None, bytearray(b"xy"))], "a string, b binary")
    assert common.small(df, ["a", "b"], 133) and not common.small(df, ["a", "b"], 132) and common.small(df.limit(0), ["a"], 0)


def test_windows_take_few_passes_and_only_text_around_repeats():
    """Least values of neighbours by doubled covers, not by a pass over copies in reversed order; and no more text than strings around repeated suffixes cover."""
    x, calls = np.random.default_rng(5).integers(0, 2**64, 5000, dtype=np.uint64), []

    def least(a, b):
        calls.append(len(a))
        return np.minimum(a, b)

    for w in (1, 2, 7, 64, 301, 5000, 5001):
        calls.clear()
        assert suffix.sliding(x, w, least).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
        assert len(calls) <= w.bit_length()
    data = np.random.default_rng(6).integers(0, 256, 400_000).astype(np.uint8)
    ends = np.array([0, 1000, 1000, 130_900, 262_100, 262_700, 400_000])
    pos = np.array([500, 1200, 131_000, 131_350, 262_500, 399_700])
    begin, cut, near = suffix.surroundings(data, ends, pos, 400, 100)
    assert len(near) == cut[-1] <= 700 * len(pos)
    covered = np.zeros(len(data), bool)
    for p in pos:
        covered[max(0, p - 300) : p + 400] = True
    assert near.tobytes() == data[covered].tobytes() and np.diff(cut, prepend=0).sum() == covered.sum() and covered[begin].all()


def test_words_hashed_together_as_alone():
    texts = [b"ab cd", b"", b"  x ", b"y" * 70_000 + b" ab", b"cd\nab"]
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    got = common.word_hashes(data, *common.word_bounds(data), suffix._FOUR)
    one = lambda w: common.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), suffix._FOUR)[0]
    assert got.tolist() == [one(w) for t in texts for w in t.split()]
    common.powers((1 << 20) + 1)
    up, down = common.powers(5)
    assert (up * down == 1).all() and len(up) == 5 and next(iter(common._POWERS)) <= common.POWERS_KEPT


def test_odds_are_worked_out_once_for_equal_contexts():
    """Class odds once a history, place odds once for words of a class with the same features; chances equal those of a plain loop, whatever the order of events."""
    gen = np.random.default_rng(9)
    m = maxent.Model([(i, 900 - i) for i in range(800)], 500_000, 900)
    m.class_rows += gen.normal(size=m.class_rows.shape).astype(np.float32)
    m.place_rows += gen.normal(size=m.place_rows.shape).astype(np.float32)
    pair, two, one, y = (gen.integers(0, k, 6000).astype(np.uint64) for k in (20, 30, 4, 800))
    e = pair << np.uint64(48) | two << np.uint64(32) | one << np.uint64(16) | y
    kinds, count = maxent.counted(e)
    histories = len({int(x) >> 16 for x in e})
    places = len({(*map(int, r), int(w) // 64) for *r, w in zip(*m.place_features(kinds), kinds & np.uint64(0xFFFF), strict=True)})
    assert sum(len(odds) for *_, odds in m.class_odds(kinds)) == histories < len(kinds)
    assert sum(len(odds) for *_, odds in m.place_odds(kinds)) == places < len(kinds) // 2
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    want, ec, ep = [], np.zeros(m.class_rows.shape), np.zeros(m.place_rows.shape)
    for i in range(len(e)):
        x, w = e[i : i + 1], int(y[i])
        cr, pr = ([int(r[0]) for r in f(x)] for f in (m.class_features, m.place_features))
        a = softmax(m.class_bias.astype(float) + m.class_rows[cr].sum(0, dtype=float))
        b = softmax(m.place_bias[w // 64].astype(float) + m.place_rows[pr].sum(0, dtype=float))
        want.append(np.log10(a[w // 64] * b[w % 64]))
        for r in cr:
            ec[r] += a
        for r in pr:
            ep[r] += b
    assert np.allclose(m.log10(e, np.zeros(len(e))), want, atol=1e-4)
    m.fresh = False
    _, got_ec, _, got_ep = maxent.sums(kinds, count, m)
    assert np.allclose(got_ec, ec, rtol=1e-3, atol=1e-3) and np.allclose(got_ep, ep, rtol=1e-3, atol=1e-3)


def test_distinct_words_as_by_sorting():
    h = np.random.default_rng(4).integers(0, 2**64, 300, dtype=np.uint64)[np.random.default_rng(5).integers(0, 300, 5000)]
    for x in (h, h[:1], h[:0]):
        words, codes = maxent.distinct(x)
        want = np.unique(x, return_inverse=True)
        assert words.dtype == np.uint64 and words.tolist() == want[0].tolist() and codes.tolist() == want[1].tolist()
