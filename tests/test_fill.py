"""The greedy fill against a loop of single choices, and the numbering of rows that it rests on."""

import random
from collections import Counter

import pytest

from reviewspark.operators import fill, ordering

SOURCE = "review_id string, label int, text_label int, fold int, product_id string, used int, capacity int"


def loop(sources, counts, texts, target, text_target):
    """One draft after another, as the rule states it."""
    counts, texts = Counter(counts), Counter(texts)
    used, left, picks = {r[0]: r[5] for r in sources}, {r[0]: r[6] for r in sources}, []
    while True:
        best = None
        for rid, label, text, fold, product, *_ in sources:
            lack = max(0, target - counts[label]), max(0, text_target - texts[text])
            if left[rid] > 0 and any(lack):
                key = (-sum(x > 0 for x in lack), used[rid], -sum(lack), fold, product, rid)
                best = min(best, (key, rid, label, text)) if best else (key, rid, label, text)
        if best is None:
            return sorted(picks), counts, texts
        _, rid, label, text = best
        picks.append((rid, used[rid]))
        used[rid] += 1
        left[rid] -= 1
        counts[label] += 1
        texts[text] += 1


def pair_loop(sources, pairs, have, minimum):
    counts, used, left, picks, short = Counter(have), {r[0]: r[5] for r in sources}, {r[0]: r[6] for r in sources}, [], []
    for pair in sorted(((a, s) for a in range(10) for s in range(3)), key=lambda p: have.get(p, 0)):
        while counts[pair] < minimum:
            able = [(used[r[0]], r[3], r[4], r[0]) for r in sources if r[1] == 0 and left[r[0]] > 0 and pair in pairs.get(r[0], ())]
            if not able:
                short.append((*pair, counts[pair]))
                break
            rid = min(able)[-1]
            picks.append((rid, used[rid]))
            used[rid] += 1
            left[rid] -= 1
            counts.update(pairs[rid])
    return picks, counts, short


def some_sources(rng, n, capacity):
    return [(f"r{i}", rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([0, 0, 1, 2, 3]), rng.randrange(3), f"p{rng.randrange(5)}", rng.randrange(3), rng.randrange(capacity)) for i in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_both_targets_against_the_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(fill, "PAGE", 3)
    rng = random.Random(seed)
    rows = some_sources(rng, rng.choice([3, 30, 60]), rng.choice([2, 9]))
    counts, texts, goal = {i: rng.randrange(30) for i in range(4)}, {i: rng.randrange(30) for i in range(4)}, rng.choice([25, 40])
    got = fill.both_targets(spark.createDataFrame(rows, SOURCE), counts, texts, 30, goal)
    want, c, t = loop(rows, counts, texts, 30, goal)
    assert sorted((r["review_id"], r["use"]) for r in got.picks.collect()) == want
    assert got.counts == {i: c[i] for i in range(4)} and got.text_counts == {i: t[i] for i in range(4)}
    assert sum(x["lacks"] for x in got.unfillable) == sum(max(0, 30 - c[i]) + max(0, goal - t[i]) for i in range(4))


def simulated(cells, lack, rows):
    """Phases over queues in memory: like the loop, with one level of use, and how many heads were looked at."""
    looked = []

    def head(i, n):
        looked.append((i, n))
        return rows[i][n]

    phase = fill.Phase([(ts, len(r)) for ts, r in zip(cells, rows, strict=True)], dict(lack), head)
    return phase.run(), phase.lack, len(looked)


@pytest.mark.parametrize("seed", range(60))
def test_rounds_take_what_single_choices_take(seed):
    rng = random.Random(seed)
    cells = rng.sample([(a, 4 + b) for a in range(4) for b in range(4)], rng.randint(1, 7)) if seed % 3 else [(t,) for t in rng.sample(range(8), rng.randint(1, 5))]
    lack = {t: rng.randint(1, 120) for ts in cells for t in ts}
    rows = [sorted((rng.random(),) for _ in range(rng.randint(1, 150))) for _ in cells]
    taken, left, _ = simulated(cells, lack, rows)
    want, now = [0] * len(cells), dict(lack)
    while all(n < len(r) for n, r in zip(want, rows, strict=True)) and all(v > 0 for v in now.values()):
        i = min(range(len(cells)), key=lambda i: (-sum(now[t] for t in cells[i]), rows[i][want[i]]))
        want[i] += 1
        for t in cells[i]:
            now[t] -= 1
    assert taken == want and left == now


def test_rounds_look_at_few_rows():
    cells = [(0, 4), (1, 5), (2, 5), (2, 6)]
    n = 200_000
    rows = [[(i * 7 + k,) for i in range(n)] for k in range(4)]
    taken, _, looked = simulated(cells, {t: 150_000 + 9 * t for ts in cells for t in ts}, rows)
    assert sum(taken) > 100_000 and looked < 500


@pytest.mark.parametrize("seed", range(3))
def test_pairs_then_labels_against_the_loops(spark, seed):
    rng = random.Random(seed)
    rows = some_sources(rng, 50, 5)
    pairs = {r[0]: {(rng.randrange(10), rng.randrange(3)) for _ in range(rng.randint(1, 3))} for r in rows if r[1] == 0}
    have = Counter(p for x in pairs.values() for p in x)
    counts, texts = Counter(r[1] for r in rows), Counter(r[2] for r in rows)
    frame = spark.createDataFrame([(k, *p) for k, x in pairs.items() for p in x], "review_id string, aspect int, sentiment int")
    got = fill.fill_targets(spark.createDataFrame(rows, SOURCE), frame, counts, texts, have, 4)
    first, pair_counts, short = pair_loop(rows, pairs, have, 4)
    extra = Counter(k for k, _ in first)
    by_id = {r[0]: r for r in rows}
    for k, _ in first:
        counts[by_id[k][1]] += 1
        texts[by_id[k][2]] += 1
    later = [(*r[:5], r[5] + extra[r[0]], r[6] - extra[r[0]]) for r in rows]
    second, c, t = loop(later, counts, texts, max(counts.values()), max(texts.values()))
    assert sorted((r["review_id"], r["use"]) for r in got.picks.collect()) == sorted(first + second)
    assert got.pair_counts == {p: pair_counts[p] for p in got.pair_counts}
    assert [(x["aspect"], x["sentiment"], x["count"]) for x in got.unfillable if "aspect" in x] == short
    assert got.counts == {i: c[i] for i in range(4)} and got.text_counts == {i: t[i] for i in range(4)}


def test_one_target(spark):
    rows = some_sources(random.Random(1), 60, 4)
    counts = Counter(r[1] for r in rows)
    goal = max(counts.values()) + 5
    got = fill.one_target(spark.createDataFrame(rows, SOURCE).drop("text_label"), counts, goal).collect()
    for label in range(4):
        uses = sorted((r[5] + k, r[3], r[4], r[0]) for r in rows if r[1] == label for k in range(r[6]))
        want = [(u[-1], u[0]) for u in uses[: goal - counts[label]]]
        assert [(r["review_id"], r["use"]) for r in sorted(got, key=lambda r: r["turn"]) if r["label"] == label] == want


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(500)] + [("hot", 7, 1)] * 300
    got = ordering.numbered(spark.createDataFrame(rows, "g string, v int, w int").repartition(7), ["g"], ["v", "w"]).collect()
    order = lambda r: tuple((x is not None, x or 0) for x in (r["v"], r["w"]))
    for g in ("a", "b", None, "hot"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])
        assert [r["at"] for r in own] == list(range(len(own))) and [order(r) for r in own] == sorted(map(order, own))
