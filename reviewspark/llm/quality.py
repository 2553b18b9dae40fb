"""Operator 4: a weak-label quality model: labeller accuracies by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import LOWER, mix, prefix_hash, sliced, span_hash, table, table_of_bytes, text_bytes

BUCKETS = 1 << 20
LEVELS = 8
STEM = 5
CHUNK = 1 << 18
#: Labellers by name; each fires for text that it takes for bad. The last two are people's labels.
LABELLERS = ("symbols", "capitals", "exclamation", "repeated_words", "repeated_lines", "fragments", "insults", "judged_low", "judged_toxic")
#: Common insults, for the labeller of that name where no labels teach it others.
INSULTS = ("idiot", "moron", "scum", "loser", "pathetic", "worthless", "stupid", "trash", "disgusting", "clown")
_VALUES = table_of_bytes(44)
_WORD = np.zeros(256, np.int8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _hash_of(word: bytes) -> int:
    d = np.frombuffer(word, np.uint8)
    return int(mix(span_hash(prefix_hash(d, _VALUES), np.array([0]), np.array([len(d)])))[0] % np.uint64(BUCKETS))


def statistics(t: bytes) -> list[float]:
    """Shares that the labellers look at: symbols, capitals, exclamation marks, distinct words, distinct lines, bars; then words."""
    n = max(1, len(t))
    words, lines = t.split(), t.split(b"\n")
    plain = len(t.translate(None, b"#$%&*+<=>@\\^_`{|}~"))
    capital = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [1 - plain / n, capital / n, t.count(b"!") / n, len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), t.count(b" | ") / max(1, len(words)), float(len(words))]


#: Upper ends of the levels of each statistic.
_CUTS = [
    [0.002, 0.01, 0.03, 0.06, 0.12, 0.2, 0.3],
    [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6],
    [0.001, 0.005, 0.02, 0.05, 0.1, 0.15, 0.2],
    [0.05, 0.1, 0.2, 0.35, 0.45, 0.6, 0.8],
    [0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95],
    [0.005, 0.02, 0.1, 0.2, 0.3, 0.4, 0.45],
    [1, 5, 10, 25, 100, 500, 2000],
]
SIZE = BUCKETS + len(_CUTS) * LEVELS


def votes(stats: np.ndarray, insult: np.ndarray, low: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 where a labeller fires, 0 where it doesn't, -1 where it says nothing."""
    long_ = stats[:, 6] >= 20
    fired = [stats[:, 0] > 0.08, stats[:, 1] > 0.3, stats[:, 2] > 0.05, long_ & (stats[:, 3] < 0.3), long_ & (stats[:, 4] < 0.4), long_ & (stats[:, 5] > 0.15), insult]
    return np.stack([*[f.astype(np.int8) for f in fired], low, toxic], 1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word beginnings and levels of the statistics of each text, each once: (text, feature), and the statistics."""
    stats = np.array([statistics(t) for t in texts]).reshape(len(texts), len(_CUTS))
    docs, feats = [], []
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        data = np.frombuffer(b" ".join(texts[at:to]).translate(LOWER), np.uint8)
        edge = np.diff(_WORD[data], prepend=np.int8(0), append=np.int8(0))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        prefix = prefix_hash(data, _VALUES)
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[at:to]]), lo, side="right") + at
        stem = hi - lo > STEM
        both = np.concatenate([mix(span_hash(prefix, lo, hi)), mix(span_hash(prefix, lo[stem], lo[stem] + STEM) + np.uint64(7))]) % np.uint64(BUCKETS)
        key = np.unique(np.concatenate([of, of[stem]]).astype(np.uint64) << np.uint64(32) | both)
        docs.append((key >> np.uint64(32)).astype(np.int64))
        feats.append((key & np.uint64(2**32 - 1)).astype(np.int64))
        at = to
    for j, cuts in enumerate(_CUTS):
        docs.append(np.arange(len(texts)))
        feats.append(BUCKETS + j * LEVELS + np.searchsorted(cuts, stats[:, j]))
    return np.concatenate(docs), np.concatenate(feats), stats


def expectation_maximisation(v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "bad" for each row of votes, and of each labeller how often it fires on bad and on good rows.

    Labellers are independent given the truth; one that says nothing about a row has no part in it.
    Starts from: bad where any fires.
    """
    said, fired = v >= 0, v == 1
    p = np.where(fired.any(1), 0.9, 0.1)
    rates = np.zeros((v.shape[1], 2))
    for _ in range(rounds):
        for k, w in enumerate((p, 1 - p)):
            rates[:, k] = np.clip(((fired * w[:, None]).sum(0) + (0.3, 0.02)[k]) / ((said * w[:, None]).sum(0) + 1), 1e-4, 1 - 1e-4)
        prior = np.clip(p.mean(), 0.01, 0.99)
        logit = np.log(prior / (1 - prior)) + (fired @ np.log(rates[:, 0] / rates[:, 1])) + ((said & ~fired) @ np.log((1 - rates[:, 0]) / (1 - rates[:, 1])))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p, rates


class Scorer:
    """Weights of a logistic model over hashed features."""

    def __init__(self, weights: np.ndarray, bias: float, rates: np.ndarray) -> None:
        self.weights, self.bias, self.rates = weights, bias, rates

    def bad(self, texts: list[bytes]) -> np.ndarray:
        doc, feat, _ = features(texts)
        z = self.bias + np.bincount(doc, self.weights[feat], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def associated(doc: np.ndarray, feat: np.ndarray, p: np.ndarray, least: int = 4, z: float = 4.0) -> np.ndarray:
    """Features that go with one side more than chance explains."""
    n, share = np.bincount(feat, minlength=SIZE), np.clip(p.mean(), 0.01, 0.99)
    bad = np.bincount(feat, p[doc], SIZE)
    score = (bad - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    return np.flatnonzero((n >= least) & (np.abs(score) >= z) | (np.arange(SIZE) >= BUCKETS) & (n > 0))


def logistic(doc: np.ndarray, feat: np.ndarray, p: np.ndarray, chosen: np.ndarray, epochs: int = 300, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Fit soft labels by gradient steps scaled for each feature (full batch, small ridge)."""
    place = np.full(SIZE, -1)
    place[chosen] = np.arange(len(chosen))
    at = place[feat]
    d, f = doc[at >= 0], at[at >= 0]
    w, b, seen, seen_b = np.zeros(len(chosen)), 0.0, np.full(len(chosen), 1e-3), 1e-3
    for _ in range(epochs):
        err = 1 / (1 + np.exp(-np.clip(b + np.bincount(d, w[f], len(p)), -30, 30))) - p
        g = np.bincount(f, err[d], len(chosen)) + ridge * w
        gb = err.sum()
        seen += g * g
        seen_b += gb * gb
        w -= 0.3 * g / np.sqrt(seen)
        b -= 0.3 * gb / np.sqrt(seen_b)
    out = np.zeros(SIZE)
    out[chosen] = w
    return out, float(b)


def train(docs: DataFrame, labels: DataFrame | None, max_docs: int = 8000) -> Scorer:
    """Fit on a bounded sample of the labelled documents, about ``max_docs`` by a hash of the id (documented bound).

    ``labels`` has ``doc_id, quality, toxic`` (either may be null); where it is missing or names no
    document, the sample is of all documents, by a hash of id and text, and only the heuristics vote. Texts
    that repeat count once, with the least quality and the most toxicity that any of them is labelled with.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    taken = None
    if labels is not None:
        one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
        n = one.count()
        if n:
            some = one.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(2**20)) < min(2**20, -(-max_docs * 2**20 // n)))
            some = some.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
            taken = base.join(F.broadcast(some), "doc_id")  # bounded by max_docs
            if not taken.head(1):
                taken = None
    if taken is None:
        n = max(1, base.count())
        taken = base.where(F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(2**20)) < min(2**20, -(-max_docs * 2**20 // n)))
        taken = taken.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in sliced(it):
            raw = [text_bytes(t) for t in b.column(1).to_pylist()]
            doc, feat, stats = features(raw)
            order = np.argsort(doc, kind="stable")
            cut = np.split(feat[order].astype(np.uint32), np.cumsum(np.bincount(doc, minlength=len(raw)))[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(t).digest() for t in raw]), pa.array([c.tobytes() for c in cut]), pa.array([s.tobytes() for s in stats]), b.column(2), b.column(3)],
                names=["sha", "features", "stats", "quality", "toxic"],
            )

    # Once a text, before anything goes to the driver.
    taken = taken.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = taken.select("digest", "text", "quality", "toxic").mapInArrow(extract, "sha binary, features binary, stats binary, quality int, toxic int").toArrow().to_pandas()
    rows = rows.sort_values("sha")
    if rows.empty:
        return Scorer(np.zeros(SIZE), -1.0, np.zeros((len(LABELLERS), 2)))
    sets = [np.frombuffer(x, np.uint32) for x in rows["features"]]
    doc, feat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)
    stats = np.stack([np.frombuffer(x, np.float64) for x in rows["stats"]])
    low = rows["quality"].map({0: 1, 1: 0}).fillna(-1).to_numpy(np.int8)
    toxic = rows["toxic"].map({1: 1, 0: 0}).fillna(-1).to_numpy(np.int8)
    insults = np.zeros(SIZE, bool)
    insults[[_hash_of(w.encode()) for w in INSULTS]] = True
    known = toxic >= 0
    if (toxic == 1).any():  # words that go with judged toxicity and hardly ever with its absence
        t = (toxic == 1).astype(float)
        of = known[doc]
        chosen = associated(doc[of], feat[of], np.where(known, t, 0.0), 3, 4.0)
        n, hits = np.bincount(feat[of], minlength=SIZE), np.bincount(feat[of], t[doc[of]], SIZE)
        insults[chosen[(chosen < BUCKETS) & (hits[chosen] >= 0.9 * n[chosen])]] = True
    v = votes(stats, np.bincount(doc, insults[feat], len(sets)) > 0, low, toxic)
    p, rates = expectation_maximisation(v)
    weights, bias = logistic(doc, feat, p, associated(doc, feat, p))
    return Scorer(weights, bias, rates)


def score(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``quality_score`` (1 less the chance of "bad") of every whole text, and whether it is over a half (``accepted``).

    A null text counts as empty, a null id stays null. Repeated rows are scored alike; an empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = docs.select(*keep).schema.add("quality_score", "double").add("accepted", "boolean")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            good = 1 - shared.value.bad([text_bytes(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(good), pa.array(good > 0.5)], names=schema.names)

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a model of the labelled ones. See ``train`` and ``score``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
