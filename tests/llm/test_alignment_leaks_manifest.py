"""Decontamination, tokenizer alignment and the Merkle manifest against brute force and SQL, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from reviewspark.llm import align, decontam, merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, item long, part int, tree long"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(6)]
EMPTY = hashlib.sha256(b"").hexdigest()


def prose(n, words=VOCABULARY):
    return " ".join(RNG.choices(words, k=n))


def sql(query, *names):
    c = duckdb.connect()
    for n in names:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c.execute(query).fetchall()


def rows_of(df, texts, source=lambda i: f"s{i % 3}"):
    return df.sparkSession.createDataFrame([(i, t, "l", source(i), 1, "w", 2, 3, 4) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Decontamination


@pytest.mark.parametrize("seed", range(6))
def test_index_against_a_scan(seed):
    rng = np.random.default_rng(seed)
    sigma = int(rng.integers(3, 9))
    seq = rng.integers(1, sigma, rng.integers(1, 400))
    if seed % 2:
        seq = np.concatenate([seq, seq, seq[: len(seq) // 2]])  # long repeats
    s = [*seq.tolist(), 0]
    assert decontam.suffix_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    index = decontam.FMIndex(seq, sigma, every=int(rng.integers(1, 9)))
    width = 4
    phrases = np.zeros((60, width), np.int64)
    for p in phrases:
        n = rng.integers(1, width + 1)
        p[width - n :] = rng.integers(1, sigma, n)
    found = {}
    for i, lo, hi in zip(*index.search(phrases, (phrases > 0).sum(1)), strict=True):
        found[int(i)] = sorted(index.locate(np.arange(lo, hi)).tolist())
    for i, p in enumerate(phrases):
        p = p[p > 0].tolist()
        assert found.get(i, []) == [j for j in range(len(seq) - len(p) + 1) if s[j : j + len(p)] == p]


def leaks_by_brute_force(texts, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {(k, tuple(w[i : i + window])) for k, t in items for w in [words(t)] if w for i in range(max(1, len(w) - window + 1))}
    out = []
    for d, t in texts:
        w, hit, named = words(t), set(), set()
        for k, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    named.add(k)
        out.append((d, len(w), len(hit), sorted(n for n in named if n is not None)))
    return out


def found_leaks(df):
    return sorted((r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["items"]) for r in df.collect())


@pytest.mark.parametrize("block", [decontam.BLOCK, 40])
def test_leaks_against_brute_force(spark, block):
    texts = [None, "", "!!", prose(300), prose(50).upper(), "é😀 w1-w2\tw3", prose(40) + " foreign " + prose(9), "w0 w1", "a " * 200 + "w5", *[prose(30)] * 3]
    items = [(1, prose(7)), (2, prose(4)), (3, "w5"), (4, None), (5, "?"), (None, "w0 w1"), (7, texts[3][30:60]), (7, prose(6)), (10**12, prose(4).upper()), (8, "É😀"), (8, "É😀")]
    got = decontam.leaks(rows_of(spark.range(1), texts), spark.createDataFrame(items, "item_id long, text string"), window=4, block=block)
    assert found_leaks(got) == leaks_by_brute_force(list(enumerate(texts)), items, 4)


def test_leaks_of_long_items_and_copies(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 7)
    item = prose(60, [f"v{i}" for i in range(30)])
    texts = [item, item[3:200] + " foreign", *["x y " + item] * 5]
    got = decontam.leaks(rows_of(spark.range(1), texts), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found_leaks(got) == leaks_by_brute_force(list(enumerate(texts)), [(1, item)], 10)


def test_leaks_are_removed(spark, none):
    texts = ["Keep THIS, w1 w2! w3 w4; and this w1.", "w1 w2 w3 w4 w1 w2 w3 w4", None, "é w1 w2 w3 w4é"]
    items = spark.createDataFrame([(1, "w1 w2 w3 w4")], "item_id long, text string")
    got = decontam.without_leaks(rows_of(spark.range(1), texts), items, window=4).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "Keep THIS, ; and this w1.", 12), (1, "", 23), (2, None, 0), (3, "é w1 w2 w3 w4é", 0)]
    assert decontam.leaks(none, items).collect() == []
    no_items = decontam.leaks(rows_of(spark.range(1), texts), items.limit(0))
    assert [r["spans"] for r in no_items.collect()] == [[]] * 4


def test_decontamination_against_sql(spark):
    got = decontam.op11_decontamination(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sql(decontam.OP11_SQL, "documents", "benchmark")
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[-1] for r in want)


# Alignment


def aligned_by_brute_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    held = []
    for d, t in rows:
        a, b, groups = [], [], []
        if t:
            a, b, raw = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t), (" " + t).encode()
            ab = [bytes(level[c] for c in a_model.id_to_token(i)) for i in a]
            bb = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) != raw or b"".join(bb) != raw:
                a, b = [], []
            i = k = x = y = 0
            ga, gb = [], []
            while i < len(a) or k < len(b):
                if x <= y:
                    x += len(ab[i])
                    ga.append(a[i])
                    i += 1
                else:
                    y += len(bb[k])
                    gb.append(b[k])
                    k += 1
                if x == y:
                    groups.append((ga, gb))
                    ga, gb = [], []
        held.append((d, a, b, groups, [(p, q) for g, h in groups for p in g for q in h]))
    count = Counter(p for h in held for p in set(h[4]))
    best = defaultdict(int)
    for (p, _), c in count.items():
        best[p] = max(best[p], c)
    text = lambda g: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
    return [
        (d, len(a), len(b), len(g), len(p), sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), hashlib.sha256(text(g).encode()).hexdigest() if a else "")
        for d, a, b, g, p in held
    ]


def test_alignment_against_brute_force(spark, none, monkeypatch):
    texts = [
        None, "", " ", "  ", "\n", "a", "  two  spaces  ", "tabs\tand\r\nlines \n\n next", "trailing \n ", "<|endoftext|> </s> <0x41> <unk>", "already▁here", "Ünïcödé 😀  x y ᄀᄁ日本語 ​",
        "\x1c\x85 odd\x0bspace", "it's we'll don't 123 4567 !!! ?", "the the the", "word " * 3000, "z" * 20_000, *["same text, twice. "] * 2, "return {\r\n  x;\r\n}\n\n  end",
    ]
    texts += ["".join(RNG.choices(" \n\t\r.,'aé日😀▁0x1", k=RNG.randint(1, 60))) for _ in range(300)]
    want = aligned_by_brute_force(list(enumerate(texts)))
    got = align.aligned(rows_of(spark.range(1), texts), A, B)
    assert sorted(map(tuple, got.collect())) == want
    assert align.aligned(none, A, B).collect() == []


def test_alignment_in_small_blocks_with_a_small_memory():
    """Cut into many stretches and with parts forgotten again and again, the parts say the same."""
    texts = [prose(80, ["Alpha", "beta,", "Gamma's", "d\ne", "x  y"]) for _ in range(20)]
    al = align.Aligner(A, B)
    whole = [";".join(al.text[i] for i in al.parts([t])[0]) for t in texts]
    few, old = align.Aligner(A, B), align.STRETCH
    align.STRETCH = 50
    try:
        for k, (t, w) in enumerate(zip(texts, whole, strict=True)):
            (parts,) = few.parts([t])
            assert ";".join(few.text[i] for i in parts) == w
            few.use(np.unique(parts))
            if k % 3 == 2:
                few.make_room()
    finally:
        align.STRETCH = old
    assert 0 < len(few.known) < len(al.known) + 1


def test_bitset():
    marks = np.array([0, 5, 63, 64, 100])
    b = align.Bitset(130, marks) & align.Bitset(130, np.array([5, 64, 99]))
    assert b.select().tolist() == [5, 64]
    assert align.Bitset(130, marks).rank(np.array([0, 4, 5, 63, 64, 129])).tolist() == [1, 1, 2, 3, 4, 5]


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, align.op12_alignment(spark, SF).collect())) == sorted(aligned_by_brute_force(docs))


# Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def folded(nodes):
    """Root, and for each node its steps (before, after) up to it."""
    steps = [[] for _ in nodes]
    at = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_at = [], []
        for lo in range(0, len(nodes), 3):
            run = nodes[lo : lo + 3]
            for k, own in enumerate(at[lo : lo + 3]):
                for i in own:
                    steps[i].append((run[:k], run[k + 1 :]))
            up.append(h(*run))
            up_at.append([i for own in at[lo : lo + 3] for i in own])
        nodes, at = up, up_at
    return nodes[0], steps


def manifest_by_brute_force(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    trees = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, changed), r[0]))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    found = [folded([x[2] for x in sorted(trees[s])]) for s in sources]
    root, above = folded([f[0] for f in found])
    out = []
    for s, (sub, steps), top in zip(sources, found, above, strict=True):
        for (_, _, own, used, key), path in zip(sorted(trees[s]), steps, strict=True):
            for before, after in [*path, *top]:
                used = h(*before, used, *after)
            out.append((key, own, sub, root, h(*(x for b, a in [*path, *top] for x in (*b, *a))), used, used == root))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("case", ["one", "two", "many", "hot", "lone sources"])
def test_manifest_against_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(merkle, "PART", 20)
    n = {"one": 1, "two": 2, "many": 200, "hot": 400, "lone sources": 150}[case]
    source = {"hot": lambda i: "big" if i % 3 else f"s{i}", "lone sources": str}.get(case, lambda i: None if i % 7 == 0 else f"é{i % 5}")
    rows = [(i if i % 11 else None, None if i % 13 == 0 else f"t\n{i % 4}\n" if i % 2 else "", "l" if i % 3 else None, source(i), i if i % 5 else None) for i in range(n)]
    rows += rows[: n // 4] + rows[:1] * (n // 3)  # equal rows
    df = spark.createDataFrame([(*r, "w", 2, 3, 4) for r in rows], SCHEMA)
    even = merkle.F.crc32(merkle.F.col("doc_id").cast("string")) % 2 == 0
    got = merkle.manifest(df.repartition(5), merkle.COLUMNS, {"text": merkle.F.replace("text", merkle.F.lit("\n"), merkle.F.lit(""))}, even)
    assert in_order(map(tuple, got.collect())) == in_order(manifest_by_brute_force(rows))


def test_empty_manifest(none):
    got = merkle.manifest(none)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.collect() == []


def test_forests_merge_in_any_order():
    sizes = [1, 4, 27, 31]
    leaves = [((t, 0, i), h(f"{t}.{i}"), n) for t, n in enumerate(sizes) for i in range(n)]
    want = folded([folded([h(f"{t}.{i}") for i in range(n)])[0] for t, n in enumerate(sizes)])[0]
    for _ in range(10):
        RNG.shuffle(leaves)
        forests = []
        for lo in range(0, len(leaves), 9):
            forests.append(merkle.Forest(len(sizes), {}))
            for x in leaves[lo : lo + 9]:
                forests[-1].add(*x)
        while len(forests) > 1:
            a, b = forests.pop(RNG.randrange(len(forests))), forests.pop(RNG.randrange(len(forests)))
            forests.append(a.merged(b))
        assert [d for d, _ in forests[0].open.values()] == [want]


def test_manifest_of_documents_against_sql(spark):
    got = [tuple(r) for r in merkle.op13_merkle(spark, SF).collect()]
    assert sorted(got) == sorted(sql(merkle.OP13_SQL, "documents")) and len({r[3] for r in got}) == 1 and {r[6] for r in got} == {True, False}
