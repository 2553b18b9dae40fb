"""Operator 2: language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import sliced, table, text_bytes

#: Bytes that stand before the first of a text, so that it has contexts too.
PAD = b"\n\n\n"
#: Byte pairs with a place of their own in the table of code lengths.
PAIRS = 2047
#: Bytes scored together.
CHUNK = 1 << 18


def grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it, as one integer."""
    b = np.frombuffer(PAD + data, np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


class ContextTree:
    """Frozen counts of one language: contexts of three bytes down to none, with escapes.

    A symbol seen n(s) times in a context with n symbols of u kinds costs -log2(n(s)/(n+u)); an
    unseen one costs -log2(u/(n+u)) and then what it costs one byte shorter. A context never seen
    is left for free. Without any context a byte costs 8 bits.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.levels = []
        for k in (3, 2, 1, 0):
            sym, at = np.unique(keys & np.uint32(2 ** (8 * k + 8) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(sym))
            ctx, first, kinds = np.unique(sym >> np.uint32(8), return_index=True, return_counts=True)
            self.levels.append((sym, n, ctx, np.add.reduceat(n, first) if len(n) else n, kinds))

    def cost(self, g: np.ndarray) -> np.ndarray:
        """Code length in bits of each gram's last byte after the others."""
        out, open_ = np.zeros(len(g)), np.ones(len(g), bool)
        for k, (sym, n, ctx, total, kinds) in zip((3, 2, 1, 0), self.levels, strict=True):
            if not len(sym):
                break
            key = g & np.uint32(2 ** (8 * k + 8) - 1)
            c = np.minimum(np.searchsorted(ctx, key >> np.uint32(8)), len(ctx) - 1)
            seen = open_ & (ctx[c] == key >> np.uint32(8))
            s = np.minimum(np.searchsorted(sym, key), len(sym) - 1)
            hit = seen & (sym[s] == key)
            out[hit] += np.log2((total[c] + kinds[c])[hit] / n[s][hit])
            miss = seen & ~hit
            out[miss] += np.log2((total[c] + kinds[c])[miss] / kinds[c][miss])
            open_ &= ~hit
        out[open_] += 8
        return out


class Model:
    """Code lengths under every language at once; grams outside the table are worked out as they come."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        self.trees = [ContextTree(*counts[x]) for x in self.langs]
        seen = np.unique(np.concatenate([counts[x][0] for x in self.langs])) if counts else np.zeros(0, np.uint32)
        both = np.concatenate([seen >> np.uint32(16), seen & np.uint32(0xFFFF)])
        pairs, often = np.unique(both, return_counts=True)
        self.pair = np.zeros(65536, np.int32)
        top = pairs[np.argsort(-often, kind="stable")][:PAIRS]
        self.pair[top] = np.arange(1, len(top) + 1)
        a, b = self.pair[seen >> np.uint32(16)], self.pair[seen & np.uint32(0xFFFF)]
        held = (a > 0) & (b > 0)
        self.grams = seen[held]
        self.bits = np.stack([t.cost(self.grams) for t in self.trees], 1).astype(np.float32) if self.langs else None

    def rows(self) -> np.ndarray:
        """For each two pairs the row of ``bits``, or -1. Built where it is used, to be sent nowhere."""
        out = np.full((PAIRS + 1, PAIRS + 1), -1, np.int32)
        out[self.pair[self.grams >> np.uint32(16)], self.pair[self.grams & np.uint32(0xFFFF)]] = np.arange(len(self.grams), dtype=np.int32)
        return out

    def score(self, texts: list[bytes], rows: np.ndarray) -> np.ndarray:
        """Code length of each whole text under each language, in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        held, size = [], 0
        for i, t in enumerate(texts):
            if t:
                held.append((i, grams(t)))
                size += len(t)
            if size > CHUNK or (held and i == len(texts) - 1):
                for lo in range(0, size, 4 * CHUNK):
                    self._add(held, lo, lo + 4 * CHUNK, rows, out)
                held, size = [], 0
        if held:
            for lo in range(0, size, 4 * CHUNK):
                self._add(held, lo, lo + 4 * CHUNK, rows, out)
        return out

    def _add(self, held: list[tuple[int, np.ndarray]], lo: int, hi: int, rows: np.ndarray, out: np.ndarray) -> None:
        g = (np.concatenate([x for _, x in held]) if len(held) > 1 else held[0][1])[lo:hi]
        ends = np.clip(np.cumsum([len(x) for _, x in held]) - lo, 0, len(g))
        starts = np.concatenate([[0], ends[:-1]])
        at = rows[self.pair[g >> np.uint32(16)], self.pair[g & np.uint32(0xFFFF)]]
        cost = self.bits[at]
        if len(rare := np.flatnonzero(at < 0)):
            kinds, back = np.unique(g[rare], return_inverse=True)
            cost[rare] = np.stack([t.cost(kinds) for t in self.trees], 1)[back]
        full = ends > starts
        sums = np.add.reduceat(cost, starts[full], axis=0, dtype=np.float64)
        out[np.array([i for i, _ in held])[full]] += sums


def train(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", docs_per_language: int = 1500) -> Model:
    """Count byte contexts for each language on a bounded sample of the labelled rows of ``df``.

    ``docs_per_language`` (documented bound) is the expected number of whole documents taken for each
    language, by a hash of the key and the text; languages with fewer give all. Null languages and texts give none,
    nor does an empty table; repeated rows count as often as they occur; other columns have no part.
    """
    labelled = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(2**20, -(-docs_per_language * 2**20 // n))))])
    taken = labelled.where(F.pmod(F.xxhash64(F.col("key").cast("string"), "text"), F.lit(2**20)) < share[F.col("lang")])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in sliced(it):
            by: dict[str, list[np.ndarray]] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(grams(text_bytes(t)))
            for k, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                if k in sums:
                    g, back = np.unique(np.concatenate([sums[k][0], g]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([sums[k][1], n])).astype(np.int64)
                sums[k] = g, n
        for k, (g, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    got = taken.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return Model({k: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.float64)) for k, g in got.groupby("lang")})


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language of every whole text: the columns ``keep``, ``lang_pred`` and ``score``.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned.
    The score is the posterior share of the best language at equal priors; ties go to the first name.
    Repeated rows are predicted alike, an empty table gives no rows, other columns have no part.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        m, letter = shared.value, regex.compile(r"\p{L}")
        rows = m.rows()
        for b in sliced(it):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            named = [bool(m.langs and t and letter.search(t)) for t in texts]
            cost = m.score([text_bytes(t) if ok else b"" for t, ok in zip(texts, named, strict=True)], rows)
            best = cost.argmin(1) if m.langs else []
            score = 1 / np.exp2(np.clip(cost.min(1, keepdims=True) - cost, -1000, 0)).sum(1) if m.langs else []
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array([m.langs[best[i]] if ok else "und" for i, ok in enumerate(named)]), pa.array([float(score[i]) if ok else 0.0 for i, ok in enumerate(named)])],
                names=schema.names,
            )

    return df.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from three quarters of the labelled documents, predict all. See ``train`` and ``predict``."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = predict(docs, train(docs.where(~F.coalesce(held_out, F.lit(False)))))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
