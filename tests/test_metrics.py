"""Threshold searches by cells against every candidate worked out by itself."""

import random

import pytest

from reviewspark.operators import metrics

CANDIDATES = [0.1 + i * 0.05 for i in range(17)]


def searched(rows, labels, candidates, fallback):
    """Macro F1 of each candidate, and the best."""
    found = []
    for t in candidates:
        picked = {}
        for i, label, _, p in rows:
            picked[i, label] = p is not None and p >= t
        if fallback:
            for i in {r[0] for r in rows}:
                own = [(r[3], -r[1]) for r in rows if r[0] == i]
                if max(own)[0] < t:
                    picked[i, -max(own)[1]] = True
        f1 = []
        for k in labels:
            own = [(truth == 1, picked[i, label]) for i, label, truth, _ in rows if label == k]
            tp, wrong = sum(a and b for a, b in own), sum(a != b for a, b in own)
            f1.append(round(2 * tp / (2 * tp + wrong), 9) if 2 * tp + wrong else 0.0)
        found.append((-round(sum(f1) / len(f1), 6), round(abs(t - 0.5), 9), t))
    best = min(found)
    return best[2], -best[0]


@pytest.mark.parametrize("fallback", [None, "i"])
def test_threshold_search(spark, fallback):
    for seed in range(3):
        rng = random.Random(seed)
        value = lambda: rng.choice([rng.choice(CANDIDATES), rng.random(), 0.0, 1.0] + ([] if fallback else [None]))  # noqa: E731, B023
        rows = [(i, k, int(rng.random() < 0.3), value()) for i in range(40) for k in range(3)]
        df = spark.createDataFrame(rows, "i long, label int, truth int, p double")
        got = metrics.threshold_search(df, CANDIDATES, fallback).first()
        t, f = searched(rows, range(3), CANDIDATES, fallback)
        assert got["threshold"] == t and got["macro_f1"] == pytest.approx(f, abs=2e-6)
    counts = metrics.threshold_counts(df, CANDIDATES, fallback)
    assert counts.count() == 17 * 3 and counts._jdf.queryExecution().toString().count("CartesianProduct") == 0
