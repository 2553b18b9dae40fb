"""Signatures and language-model scores against plain loops over Python integers and floats."""

import math
import random

import numpy as np
import pytest

from reviewspark.llm import common, maxent, minhash, warc

RNG = random.Random(21)
MASK, MULT = 2**64 - 1, 6364136223846793005
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyzé", k=RNG.randint(1, 7))) for _ in range(60)]


def finalised(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    h ^= h >> 29
    h = h * 0x9FB21C651E98DF25 & MASK
    return h ^ h >> 32


def word_hash(word, seed):
    values = [int(x) for x in common.table_of_bytes(seed)]
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in word.encode())
    return finalised(sum(values[b] * pow(MULT, i, 2**64) for i, b in enumerate(raw)) & MASK)


def shingles_of(text):
    h = [word_hash(w, 5) for w in text.split()]
    if not h:
        return set()
    if len(h) < 5:
        x = 0
        for i, v in enumerate(h):
            x ^= finalised((v + i + 1) & MASK)
        return {finalised(x) >> 32}
    out = set()
    for i in range(len(h) - 4):
        s = 0
        for v in h[i : i + 5]:
            s = (s * MULT + v) & MASK
        out.add(finalised(s) >> 32)
    return out


def test_signatures_are_minima_over_shingles():
    texts = ["", " ", "One", "two  words", " ".join(RNG.choices(WORDS, k=40)), " ".join(RNG.choices(WORDS, k=200)).upper(), "a b\tc\nd e"]
    got = minhash.signatures([t.encode() for t in texts])
    rng = np.random.default_rng(55)
    a = [2 * int(x) + 1 for x in rng.integers(0, 2**63, 128, dtype=np.uint64)]
    b = [int(x) for x in rng.integers(0, 2**63, 128, dtype=np.uint64)]
    for t, row in zip(texts, got, strict=True):
        own = shingles_of(t)
        assert row.tolist() == [min(((x * p + q) & MASK) >> 32 for x in own) if own else 2**32 - 1 for p, q in zip(a, b, strict=True)]


def test_likeness_follows_similarity():
    off = []
    for share in (0, 0.2, 0.5, 0.8, 0.95, 1):
        words = RNG.choices(WORDS, k=300)
        other = words[: int(300 * share)] + RNG.choices(WORDS, k=300 - int(300 * share))
        one, two = " ".join(words), " ".join(other)
        x, y = shingles_of(one), shingles_of(two)
        f = minhash.fingerprints([one.encode(), two.encode()])
        off.append(abs(minhash.likeness(f[:1], f[1:])[0] - len(x & y) / len(x | y)))
    assert max(off) < 0.15 and sum(off) / len(off) < 0.07


def odds(bias, rows):
    x = [float(b) + sum(float(r[i]) for r in rows) for i, b in enumerate(bias)]
    top = max(x)
    total = sum(math.exp(v - top) for v in x)
    return [math.exp(v - top) / total for v in x]


def test_scores_are_sums_of_log_probabilities(spark):
    """Every token's chance of class and place by softmaxes over the model's rows, added up document by document."""
    docs = [(i, " ".join(RNG.choices(WORDS, k=RNG.randint(0, 12))) + ("" if i % 4 else " New" + str(i)), i % 5 == 0) for i in range(36)] + [(99, None, False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean")
    blocks = maxent.blocks_of(df, ["doc_id", "held_out"], "held_out").cache()
    counts = maxent.word_counts(blocks).cache()
    n, v = counts.where("kind = 1").selectExpr("sum(n)", "sum(v)").first()
    model = maxent.train(blocks, maxent.Model(maxent.common_words(counts), n, v), "held_out")
    got = {r.doc_id: r for r in maxent.score_documents(df).collect()}

    end = int(maxent.END)
    seen = {}
    for _, text, held in docs:
        for h in [*(word_hash(w, 33) for w in (text or "").split()), end]:
            seen[h] = seen.get(h, 0) + (not held)
    assert (n, v) == (sum(seen.values()), sum(x > 0 for x in seen.values()))
    known = {int(h): int(i) for h, i in zip(model.words, model.ids, strict=True)}
    assert known.keys() == {h for h, c in seen.items() if c > 0}  # all words of so small a corpus are common ones
    start = maxent.VOCABULARY
    for doc_id, text, _ in docs:
        hashes = [*(word_hash(w, 33) for w in (text or "").split()), end]
        ids, total, base = [known.get(h, maxent.OTHER) for h in hashes], 0.0, 0.0
        for i, (h, y) in enumerate(zip(hashes, ids, strict=True)):
            one, two = ids[i - 1] if i else start, ids[i - 2] if i > 1 else start
            h1, h2 = hashes[i - 1] if i else end, hashes[i - 2] if i > 1 else end
            pair = finalised((h2 * MULT + h1) & MASK) % maxent.NGRAMS
            c = y // maxent.CLASSES
            p = odds(model.class_bias, [model.class_rows[one], model.class_rows[start + 1 + two], model.class_rows[2 * (start + 1) + pair]])[c]
            places = [finalised((one * MULT + (c + 1) * 0x9E3779B1) & MASK) % maxent.PLACES, finalised(((pair + 2**20) * MULT + c + 1) & MASK) % maxent.PLACES]
            q = odds(model.place_bias[c], [model.place_rows[k] for k in places])[y % maxent.CLASSES]
            total += math.log10(p) + math.log10(q)
            if y == maxent.OTHER:  # an unseen word's share of the one place of all others
                total += math.log10((seen[h] + 0.1) / (model.n_other + 0.1 * (model.v_other + 1)))
            base += math.log10((seen[h] + 0.1) / (n + 0.1 * (v + 1)))
        row = got[doc_id]
        assert row.n_tokens == len(hashes) and row.train_tokens == n and row.n_known == sum(seen[h] > 0 for h in hashes)
        assert row.base_score == pytest.approx(base, abs=1e-9) and row.score == pytest.approx(total, abs=5e-3)


def test_members_of_an_archive_are_read_in_pieces(monkeypatch):
    pages = [(i, f"http://a/{i}", bytes(RNG.choices(range(256), k=RNG.choice([0, 1, 500, 40_000])))) for i in range(40)]
    raw = b"".join(warc.member(k, url, payload, None, 6) for k, url, payload in pages)
    for piece in (7, 1000, warc.PIECE):
        monkeypatch.setattr(warc, "PIECE", piece)
        got = list(warc.records(raw))
        assert [block.partition(b"\r\n\r\n")[2] for _, block in got] == [p for _, _, p in pages]
        assert [f["WARC-Target-URI"] for f, _ in got] == [u for _, u, _ in pages]
    assert list(warc.records(b"")) == []
