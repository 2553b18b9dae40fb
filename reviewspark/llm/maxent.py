"""Operator 3: a hashed maximum-entropy language model with class-factored softmax.

Counts of all words come first: blocks of documents send each distinct word hash once to ranges of
the hash space, which answer with totals over the whole corpus. The commonest words are the model's
vocabulary; a word's class and place in it follow its rank. P(word | history) is P(class | history)
times P(place | class, history), both softmaxes over the sum of hashed feature rows: the word before,
the one before that (skip) and both together (n-gram). All other words share one place, divided
by their smoothed counts, so that probabilities of all words sum to one.

Training takes every position of every document; equal events are worked out once, with their
count. Each round, tasks add up what they observe and what the model expects; a step is the gradient
(observed less expected) scaled by the expectation, log-damped. Only arrays of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import LOWER, MULT, materialise, mix, sliced, table, table_of_bytes, text_bytes, word_bounds, word_hashes

CLASSES = 64
VOCABULARY = CLASSES * CLASSES
OTHER = VOCABULARY - 1
START = VOCABULARY
NGRAMS = 8192
PLACES = 8192
ROWS = 2 * (VOCABULARY + 1) + NGRAMS
#: Bytes of text in a block, unless one document is longer.
BLOCK = 8 << 20
ROUNDS = 4
#: Rows of 64 floats worked on at once: few enough to stay near the processor.
BATCH = 2048
#: Events sorted together before they are worked out.
EVENTS = 2_000_000
#: Distinct words of blocks that one range of the hash space takes in.
RANGE = 2_000_000
SHARDS = 32
#: Bytes of text whose gradient one task adds up, so that arrays of fixed size stay small next to the text.
GRADIENT = 32 << 20
END = np.uint64(0x9E3779B97F4A7C15)
ONES = np.ones(CLASSES, np.float32)
_VALUES = table_of_bytes(33)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of some texts, an end after each text, and the number of tokens of each."""
    data = np.frombuffer(b"\n".join(texts).translate(LOWER) + b"\n", np.uint8)
    stop = np.cumsum([len(t) + 1 for t in texts])
    lo, hi = word_bounds(data)
    h = word_hashes(data, lo, hi, _VALUES)
    n = np.diff(np.searchsorted(lo, stop), prepend=0) + 1
    out = np.empty(len(h) + len(stop), np.uint64)
    at = np.cumsum(n) - 1
    out[at] = END
    words = np.ones(len(out), bool)
    words[at] = False
    out[words] = h
    return out, n


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values and the place of each among them, by a hash table: only different values are sorted."""
    at, kinds = pd.factorize(h)
    order = np.argsort(kinds)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return kinds[order], rank[at]


def blocks_of(df: DataFrame, keep: list[str], held_out: str, text: str = "text") -> DataFrame:
    """Documents in blocks of about ``BLOCK`` bytes, each with its distinct words.

    ``meta`` holds the kept columns (Arrow), ``sizes`` the tokens of each document, ``words`` the
    ascending hashes of the block's words, ``counts`` how often each stands in documents to learn
    from, and ``codes`` (packed) the place of every token among the words.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, done = TaskContext.get().partitionId() << 36, 0

        def block(rows: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
            nonlocal done
            sink, meta = pa.BufferOutputStream(), pa.Table.from_batches(rows).combine_chunks()
            with pa.ipc.new_stream(sink, meta.schema) as w:
                w.write_table(meta)
            h, sizes = tokens(texts)
            words, codes = distinct(h)
            learn = ~np.repeat(meta.column(held_out).to_numpy(), sizes)
            counts = np.bincount(codes, learn, len(words)).astype(np.uint32)
            cells = [first + done, sink.getvalue().to_pybytes(), sizes.astype(np.uint32).tobytes(), words.tobytes(), counts.tobytes(), zstandard.compress(codes.astype(np.uint32).tobytes(), 3), len(words), sum(map(len, texts))]
            done += 1
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["block", "meta", "sizes", "words", "counts", "codes", "n_words", "n_bytes"])

        rows, texts, held = [], [], 0
        for b in sliced(it):
            lone = b.select(list(range(b.num_columns - 1)))
            for i in range(b.num_rows):
                t = text_bytes(b.column(b.num_columns - 1)[i].as_py())
                if texts and held + len(t) > BLOCK:
                    yield block(rows, texts)
                    rows, texts, held = [], [], 0
                rows.append(lone.slice(i, 1))
                texts.append(t)
                held += len(t)
        if texts:
            yield block(rows, texts)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, "block long, meta binary, sizes binary, words binary, counts binary, codes binary, n_words long, n_bytes long")


def meta_of(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def learned(meta: bytes, sizes: np.ndarray, held_out: str) -> np.ndarray:
    """Of each token, whether its document is one to learn from."""
    return ~np.repeat(meta_of(meta).column(held_out).to_numpy(), sizes)


def word_counts(blocks: DataFrame) -> DataFrame:
    """Totals of words in the training documents: answers to blocks (``kind`` 0) and sums and common words of each range (1).

    The number of ranges follows from the number of words that blocks send, so that a range fits a task.
    """
    sent = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-sent // RANGE), int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 4):
            for block, raw, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, count = np.frombuffer(raw, np.uint64), np.frombuffer(times, np.uint32)
                part = ((words >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)
                edges = np.searchsorted(part, np.arange(n + 1))
                out = [(p, block, words[a:e].tobytes(), count[a:e].tobytes()) for p, (a, e) in enumerate(zip(edges, edges[1:], strict=False)) if a < e]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "words", "counts"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in sliced(it, 100):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield from totals(held)
                    held = []
                held.append(r)
        if held:
            yield from totals(held)

    def totals(mine: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate([np.frombuffer(r[2], np.uint64) for r in mine])
        counts = np.concatenate([np.frombuffer(r[3], np.uint32) for r in mine])
        kinds, back = np.unique(words, return_inverse=True)
        total = np.bincount(back, counts, len(kinds)).astype(np.int64)
        at, part = 0, mine[0][0]
        for r in mine:
            size = len(r[3]) // 4
            told = total[back[at : at + size]]
            yield made(0, r[1], part, zstandard.compress(told.tobytes(), 1), b"", 0, 0)
            at += size
        top = np.lexsort([kinds, -total])[:OTHER]
        top = top[total[top] > 0]
        yield made(1, 0, part, total[top].tobytes(), kinds[top].tobytes(), int(total.sum()), int((total > 0).sum()))

    def made(*cells: object) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["kind", "block", "part", "totals", "words", "n", "v"])

    rows = blocks.select("block", "words", "counts").mapInArrow(send, "part int, block long, words binary, counts binary")
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "block").mapInArrow(add, "kind int, block long, part int, totals binary, words binary, n long, v long")


def common_words(counts: DataFrame) -> list[tuple[int, int]]:
    """The commonest words of the corpus with their counts, ties by hash: at most ``OTHER``."""

    def fewer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in it:
            for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total, words = np.concatenate([total, np.frombuffer(t, np.int64)]), np.concatenate([words, np.frombuffer(w, np.int64)])
                if len(total) > 8 * OTHER:
                    total, words = most(total, words)
        if len(total):
            total, words = most(total, words)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([words.tobytes()])], names=["totals", "words"])

    def most(total: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.lexsort([words, -total])[:OTHER]
        return total[top], words[top]

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(t, np.int64))], names=["word", "n"])

    ranges = counts.where("kind = 1").select("totals", "words", F.pmod("part", F.lit(8)).alias("some")).repartitionById(8, F.col("some"))
    rows = ranges.select("totals", "words").mapInArrow(fewer, "totals binary, words binary").mapInArrow(spread, "word long, n long").orderBy(F.desc("n"), "word").limit(OTHER)
    return [(r["word"], r["n"]) for r in rows.collect()]


def before(x: np.ndarray, steps: int, blank: np.ndarray, fill: object) -> np.ndarray:
    """The value so many places before each, and ``fill`` where ``blank``."""
    out = np.concatenate([np.full(min(steps, len(x)), fill, x.dtype), x[:-steps]])[: len(x)]
    out[blank] = fill
    return out


def add_rows(out: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    """Add each row of p to that row of ``out``, two floats at a time (as one complex number)."""
    half = out.shape[1] // 2
    np.add.at(out.view(np.complex64).reshape(-1), (rows.astype(np.int64)[:, None] * half + np.arange(half)).reshape(-1), p.view(np.complex64).reshape(-1))


def add_runs(out: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    """The same where equal rows stand together: long runs are summed where they lie."""
    first = starts(rows)
    if len(rows) < 16 * len(first):
        return add_rows(out, rows, p)
    one = np.ones(len(rows), np.float32)
    for r, a, b in zip(rows[first].tolist(), first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
        out[r] += one[a:b] @ p[a:b]


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1]) if len(x) else np.zeros(0, np.int64)


class Model:
    """Vocabulary, base counts and feature rows."""

    def __init__(self, common: list[tuple[int, int]], n: int, v: int) -> None:
        words = np.array([w for w, _ in common], np.int64).view(np.uint64)
        count = np.zeros(VOCABULARY)
        count[: len(common)] = [c for _, c in common]
        order = np.argsort(words)
        self.words, self.ids = words[order], order.astype(np.uint16)
        self.n, self.v = n, v
        self.n_other, self.v_other = n - int(count.sum()), v - len(common)
        count[OTHER] = self.n_other + 0.1 * (self.v_other + 1)
        by = count.reshape(CLASSES, CLASSES)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_bias = np.maximum(np.log(by.sum(1) / count.sum()), -30).astype(np.float32)
            self.place_bias = np.nan_to_num(np.maximum(np.log(by / by.sum(1, keepdims=True)), -30), nan=-30.0).astype(np.float32)
        self.class_rows = np.zeros((ROWS, CLASSES), np.float32)
        self.place_rows = np.zeros((PLACES, CLASSES), np.float32)
        self.fresh = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word hash."""
        if not len(self.words):
            return np.full(len(h), OTHER, np.uint16)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.ids[at], np.uint16(OTHER))

    def events(self, words: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each token as one integer: n-gram, the two words before (skip, then last), the word, 16 bits each."""
        y, h = self.known(words)[codes], words[codes]
        first = np.cumsum(sizes) - sizes
        second = first[sizes > 1] + 1
        both = np.concatenate([first, second])
        one, two = before(y, 1, first, START), before(y, 2, both, START)
        pair = mix(before(h, 2, both, END) * MULT + before(h, 1, first, END)) & np.uint64(NGRAMS - 1)
        return pair << np.uint64(48) | two.astype(np.uint64) << np.uint64(32) | one.astype(np.uint64) << np.uint64(16) | y

    @staticmethod
    def class_features(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows of the class: last word, skip, n-gram."""
        part = lambda k: (e >> np.uint64(k)).astype(np.uint16)
        return part(16), part(32) + np.uint16(VOCABULARY + 1), part(48) + np.uint16(2 * (VOCABULARY + 1))

    @staticmethod
    def place_features(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of the place: last word and n-gram, each with the class."""
        one, pair, c = e >> np.uint64(16) & np.uint64(0xFFFF), e >> np.uint64(48), (e & np.uint64(0xFFFF)) // np.uint64(CLASSES) + np.uint64(1)
        hashed = lambda x: (mix(x) & np.uint64(PLACES - 1)).astype(np.uint16)
        return hashed(one * MULT + c * np.uint64(0x9E3779B1)), hashed((pair + np.uint64(1 << 20)) * MULT + c)

    def class_odds(self, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple, np.ndarray]]:
        """Of ascending events, some at a time: their places, the row of each in the odds, the feature rows, and the odds of the classes, not yet divided by their sum.

        Odds of classes depend on the history alone, and are worked out once for all words that follow one.
        """
        first = starts(e >> np.uint64(16))
        a, b = (np.empty((min(BATCH, len(first)), CLASSES), np.float32) for _ in range(2))
        for lo in range(0, len(first), BATCH):
            some = first[lo : lo + BATCH]
            end = first[lo + BATCH] if lo + BATCH < len(first) else len(e)
            rows = self.class_features(e[some])
            odds = self.class_rows.take(rows[0], 0, a[: len(some)], "clip")
            odds += self.class_bias
            for r in rows[1:]:
                odds += self.class_rows.take(r, 0, b[: len(some)], "clip")
            yield np.arange(some[0], end), np.repeat(np.arange(len(some)), np.diff(some, append=end)), rows, np.exp(odds, out=odds)

    def place_odds(self, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple, np.ndarray]]:
        """The same of the places in an event's class: worked out once for all words with the same features and class, which the features' second row orders."""
        rows, cls = self.place_features(e), (e & np.uint64(0xFFFF)) // np.uint64(CLASSES)
        key = rows[1].astype(np.uint64) << np.uint64(32) | rows[0].astype(np.uint64) << np.uint64(16) | cls
        order = np.argsort(key)
        first = starts(key[order])
        a, b = (np.empty((min(BATCH, len(first)), CLASSES), np.float32) for _ in range(2))
        for lo in range(0, len(first), BATCH):
            some = first[lo : lo + BATCH]
            end = first[lo + BATCH] if lo + BATCH < len(first) else len(e)
            at = order[some]
            mine = tuple(r[at] for r in rows)
            odds = self.place_bias.take(cls[at].astype(np.int64), 0, a[: len(some)], "clip")
            for r in mine:
                odds += self.place_rows.take(r, 0, b[: len(some)], "clip")
            yield order[some[0] : end], np.repeat(np.arange(len(some)), np.diff(some, append=end)), mine, np.exp(odds, out=odds)

    def log10(self, e: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 P of each token; ``base``: its count in training. Equal events are worked out once."""
        kinds, back = np.unique(e, return_inverse=True)
        y, p = (kinds & np.uint64(0xFFFF)).astype(np.int64), np.zeros(len(kinds))
        for odds_of, of in ((self.class_odds, y // CLASSES), (self.place_odds, y % CLASSES)):
            for at, row, _, odds in odds_of(kinds):
                p[at] += np.log10(odds[row, of[at]].astype(np.float64) / (odds @ ONES)[row])
        out, other = p[back], y[back] == OTHER
        out[other] += np.log10((base[other] + 0.1) / (self.n_other + 0.1 * (self.v_other + 1)))
        return out


def sums(e: np.ndarray, count: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observed and expected counts of the feature rows over distinct ascending events with their counts: classes, then places.

    While all rows are zero, what is expected follows from counts of features.
    """
    y = e.astype(np.uint16)
    cls, place, n = (y // CLASSES).astype(np.uint8), (y % CLASSES).astype(np.uint8), count.astype(np.float32)

    def tally(rows: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size * CLASSES)
        for lo in range(0, len(rows), 1 << 18):
            some = slice(lo, lo + (1 << 18))
            out += np.bincount(rows[some].astype(np.int64) * CLASSES + of[some], count[some], size * CLASSES)
        return out.reshape(size, CLASSES)

    cr, pr = model.class_features(e), model.place_features(e)
    gc, gp = sum(tally(r, cls, ROWS) for r in cr), sum(tally(r, place, PLACES) for r in pr)
    if model.fresh:
        prior = np.exp(model.class_bias)
        ec = gc.sum(1, keepdims=True) * (prior / prior.sum())
        odds = np.exp(model.place_bias)
        ep = sum(tally(r, cls, PLACES) for r in pr) @ (odds / odds.sum(1, keepdims=True))
        return tuple(x.astype(np.float32) for x in (gc, ec, gp, ep))
    ec, ep = np.zeros((ROWS, CLASSES), np.float32), np.zeros((PLACES, CLASSES), np.float32)
    for odds_of, out in ((model.class_odds, ec), (model.place_odds, ep)):
        for at, row, rows, p in odds_of(e):
            p *= (np.bincount(row, n[at], len(p)) / (p @ ONES)).astype(np.float32)[:, None]
            for r in rows[:-1]:
                add_rows(out, r, p)
            add_runs(out, rows[-1], p)  # ascending, by n-gram
    return gc.astype(np.float32), ec, gp.astype(np.float32), ep


def counted(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct events, ascending, and how often each occurs."""
    s = np.sort(e)
    first = starts(s)
    return s[first], np.diff(np.append(first, len(s)))


def train(blocks: DataFrame, model: Model, held_out: str, rounds: int = ROUNDS) -> Model:
    """Fit the feature rows on every position of every training document."""
    spark = blocks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    dealt = blocks.select("meta", "sizes", "words", "codes").coalesce(max(spark.sparkContext.defaultParallelism, -(-size // GRADIENT)))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def gradient(it: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total, held, size = None, [], 0

            def add() -> None:
                nonlocal total
                some = sums(*counted(np.concatenate(held)), now.value)
                total = some if total is None else tuple(x + y for x, y in zip(total, some, strict=True))

            for b in sliced(it, 4):
                for meta, lengths, words, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    sizes = np.frombuffer(lengths, np.uint32).astype(np.int64)
                    e = now.value.events(np.frombuffer(words, np.uint64), np.frombuffer(zstandard.decompress(codes), np.uint32), sizes)
                    held.append(e[learned(meta, sizes, held_out)])
                    size += len(held[-1])
                    if size > EVENTS:
                        add()
                        held, size = [], 0
            if size:
                add()
            if total is not None:
                for kind, x in enumerate(total):
                    for s, part in enumerate(np.array_split(x, SHARDS)):
                        yield pa.RecordBatch.from_arrays([pa.array([kind * SHARDS + s], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)])], names=["shard", "x"])

        def add_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[int, np.ndarray] = {}
            for b in it:
                for s, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(zstandard.decompress(z), np.float32).astype(np.float64)
                    got[s] = got[s] + x if s in got else x
            for s, x in got.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.astype(np.float32).tobytes()])], names=["shard", "x"])

        summed = dealt.mapInArrow(gradient, "shard int, x binary").repartitionById(min(n, 4 * SHARDS), F.col("shard")).mapInArrow(add_up, "shard int, x binary")
        parts = {r["shard"]: np.frombuffer(r["x"], np.float32) for r in summed.collect()}
        if not parts:
            break
        gc, ec, gp, ep = (np.concatenate([parts[k * SHARDS + s] for s in range(SHARDS)]).reshape(-1, CLASSES) for k in range(4))
        for rows, g, e, features in ((model.class_rows, gc, ec, 3), (model.place_rows, gp, ep, 2)):
            g = g - e
            rows += np.sign(g) * np.log1p(np.abs(g) / (e + 2.0)) / features
        model.fresh = False
        now.unpersist()
    return model


def score_documents(df: DataFrame, held_out: str = "held_out", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that aren't held out and score every whole text, held out or not.

    Tokens are runs without ASCII white space, A-Z lower-cased, and one end for each text (null: empty).
    Returns ``key, held_out, n_tokens, n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (unigrams, 0.1 added, one more word than seen) and ``score`` (the model), both log10.
    Repeated rows count and come out as often as they went in; an empty table gives no rows; with
    nothing to learn from all words are equally new. Other columns, whatever their names, have no part.
    """
    spark = df.sparkSession
    blocks = materialise(blocks_of(df, [key, held_out], held_out, text), "maxent-blocks")
    counts = materialise(word_counts(blocks), "maxent-counts")
    got = counts.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    model = train(blocks, Model(common_words(counts), got["n"], got["v"]), held_out)
    shared = spark.sparkContext.broadcast(model)
    told = counts.where("kind = 0").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "totals"))), lambda x: x["totals"]).alias("totals"))
    schema = df.select(key, held_out).schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(it, 4):
            for meta, lengths, words, z, totals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size, codes = np.frombuffer(lengths, np.uint32).astype(np.int64), np.frombuffer(zstandard.decompress(z), np.uint32)
                total = np.frombuffer(b"".join(map(zstandard.decompress, totals)), np.int64)
                first = np.cumsum(size) - size
                base = np.log10((total + 0.1) / (m.n + 0.1 * (m.v + 1)))[codes]
                full = m.log10(m.events(np.frombuffer(words, np.uint64), codes, size), total[codes])
                t = meta_of(meta).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays(
                    [*t.columns, pa.array(size), pa.array(np.add.reduceat((total > 0)[codes].astype(np.int64), first)), pa.array(np.full(len(size), m.n, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(full, first))],
                    names=schema.names,
                )

    return blocks.drop("counts").join(told, "block").select("meta", "sizes", "words", "codes", "totals").mapInArrow(run, schema)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from nine tenths of the documents, score all; rows without an id are never held out. See ``score_documents``."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))))
