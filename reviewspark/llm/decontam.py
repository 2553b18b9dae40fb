"""Operator 11: benchmark decontamination by an FM-index of each shard of the training texts.

A shard is a few megabytes of documents. Its words become numbers of the test phrases' vocabulary; all
others are one foreign symbol that no phrase holds, so only runs of known words at least as long as the
shortest phrase are indexed, with a separator after each. The index is the Burrows-Wheeler transform of that sequence as a
wavelet matrix, with the positions of every ``EVERY``-th suffix. Phrases are searched backwards, all at
once; a phrase drops out when its range is empty. Occurrences are located by walking to a sampled
suffix, and overlapping or touching ones are merged into spans.

Test items are read in blocks of bounded size, so that a large benchmark takes more passes, not more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import materialise, sliced, table, text_bytes

#: Words of a window.
WINDOW = 10
#: Bytes of text in a shard, unless one document is longer.
SHARD = 8 << 20
#: Bytes of test items that are searched at once, and window starts in a piece of a long item.
BLOCK, PIECE = 4 << 20, 20_000
#: Of the suffixes' positions, one in so many is kept.
EVERY = 16
#: Words are runs of digits, ASCII letters and all other characters above ASCII; A-Z count as a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SPANS = "array<struct<first:long,last:long,start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in lower case; a null has none."""
    return text_bytes(text).translate(WORDS).split()


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of a sequence in the order of its suffixes, by doubling the compared length where suffixes still tie."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.diff(s[order], prepend=s[order[0]] - 1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    size = np.diff(first, append=n)
    left = order[np.repeat(size > 1, size)]
    k = 1
    while len(left):
        ahead = left + k
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[left]))
        left, second = left[by], second[by]
        group = rank[left]
        new_group = np.diff(group, prepend=-1) != 0
        new = new_group | (np.diff(second, prepend=-2) != 0)
        at = np.arange(len(left))
        base = np.maximum.accumulate(np.where(new_group, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[left] = group + start - base
        starts = np.flatnonzero(new)
        size = np.diff(starts, append=len(left))
        left = left[np.repeat(size > 1, size)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """A bit vector with counts of the bits before each 64-bit word."""

    def __init__(self, b: np.ndarray) -> None:
        padded = np.zeros(len(b) // 64 * 64 + 64, np.uint8)
        padded[: len(b)] = b
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Bits set before i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class FMIndex:
    """Backward search and location in a sequence of symbols 1 to sigma - 1."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = EVERY) -> None:
        s = np.concatenate([seq, [0]]).astype(np.int64)  # 0 ends the sequence
        order = suffix_order(s)
        last = s[order - 1]  # the symbol before each suffix
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.levels = []
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            b = ((last >> bit) & 1).astype(np.uint8)
            bits = Bits(b)
            self.levels.append((bit, bits, len(last) - bits.ones))
            last = np.concatenate([last[b == 0], last[b == 1]])
        symbols = np.arange(sigma)
        self.base = self.start[:-1] - self.down(symbols, np.zeros(sigma, np.int64))
        sampled = order % every == 0
        self.marked, self.places = Bits(sampled), order[sampled]

    def down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where places i of the transform come to by the bits of the symbols c."""
        for bit, bits, zeros in self.levels:
            one = bits.rank(i)
            i = np.where((c >> bit) & 1, zeros + one, i - one)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First suffix that starts with c and goes on with suffix i or a later one."""
        return self.base[c] + self.down(c, i)

    def back(self, i: np.ndarray) -> np.ndarray:
        """The suffix that starts one place before suffix i."""
        c, at = np.zeros(len(i), np.int64), i
        for _, bits, zeros in self.levels:
            b = bits.get(at).astype(np.int64)
            one = bits.rank(at)
            c, at = 2 * c + b, np.where(b, zeros + one, at - one)
        return self.base[c] + at

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and their ranges of suffixes. ``phrases``: rows of symbols, set to the right."""
        width = phrases.shape[1] if phrases.ndim == 2 else 0
        live = np.flatnonzero(length > 0)
        lo = self.start[phrases[live, -1]] if width else np.zeros(0, np.int64)
        hi = self.start[phrases[live, -1] + 1] if width else lo
        for j in range(width - 1, -1, -1):
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
            if j < width - 1:
                more = np.flatnonzero(length[live] >= width - j)
                c = phrases[live[more], j]
                lo[more], hi[more] = self.step(c, lo[more]), self.step(c, hi[more])
        some = lo < hi
        return live[some], lo[some], hi[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes in the sequence."""
        out, at, which, walked = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(at):
            hit = self.marked.get(at) > 0
            out[which[hit]] = self.places[self.marked.rank(at[hit])] + walked
            at, which = self.back(at[~hit]), which[~hit]
            walked += 1
        return out


class Phrases:
    """The distinct windows of some items, as rows of word numbers (from 2), with the items that hold each."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, (_, words) in enumerate(items):
            ids = np.array([number(w, len(self.vocabulary) + 2) for w in words], np.int32)
            if len(ids) < window:
                ids = np.concatenate([np.zeros(window - len(ids), np.int32), ids])
            own = np.lib.stride_tricks.sliding_window_view(ids, window)
            rows.append(own)
            owner.append(np.full(len(own), k))
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.rows > 0).sum(1)
        named = np.array([i is not None for i, _ in items], bool)
        pair = np.unique(np.stack([which.ravel(), np.concatenate(owner)], 1), axis=0)
        pair = pair[named[pair[:, 1]]] if len(pair) else pair
        self.items = np.array([i or 0 for i, _ in items], np.int64)[pair[:, 1]]
        self.at = np.searchsorted(pair[:, 0], np.arange(len(self.rows) + 1))
        self.least = int(self.length.min()) if len(self.rows) else 0

    def __len__(self) -> int:
        return len(self.rows)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def occurrences(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases start in a shard's word numbers (0: a foreign word or the end of a text), and which."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(ids > 0, prepend=False, append=False))
    a, b = edge[::2], edge[1::2]
    long = b - a >= max(1, phrases.least)
    if not len(phrases) or not long.any():
        return none
    kept = ranges(a[long], b[long] + 1)  # each run with the foreign place that ends it
    index = FMIndex(np.where(ids[kept] > 0, ids[kept], 1), len(phrases.vocabulary) + 2)
    which, lo, hi = index.search(phrases.rows, phrases.length)
    return kept[index.locate(ranges(lo, hi))], np.repeat(which, hi - lo)


class Shard:
    """Texts whose words are searched together; equal texts count once."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.slot, self.ids, self.size = phrases, {}, [], 0

    def add(self, text: str | None) -> int:
        """Number of a text in this shard."""
        found = self.slot.setdefault(text or "", len(self.slot))
        if found == len(self.ids):
            words = words_of(text)
            get = self.phrases.vocabulary.get
            self.ids.append(np.array([get(w, 0) for w in words], np.int32))
            self.size += len(text or "")
        return found

    def hits(self) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
        """Of each text: words, merged spans of hit words, and the items whose windows occur."""
        count = [len(x) for x in self.ids]
        spans: list[list[tuple[int, int]]] = [[] for _ in count]
        items: list[list[int]] = [[] for _ in count]
        gap = np.zeros(1, np.int32)
        starts = np.cumsum([0, *[n + 1 for n in count]])
        ids = np.concatenate([y for x in self.ids for y in (x, gap)]) if count else gap
        at, which = occurrences(ids, self.phrases)
        if len(at):
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.phrases.length[which], -1)
            edge = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False, append=False))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # the gap after each text ends a span
                doc = int(np.searchsorted(starts, a, side="right")) - 1
                spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
            pair = np.unique(np.stack([np.searchsorted(starts, at, side="right") - 1, which], 1), axis=0)
            cut = np.flatnonzero(np.diff(pair[:, 0], prepend=-1))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(pair)], strict=True):
                w = pair[i:j, 1]
                items[pair[i, 0]] = np.unique(self.phrases.items[ranges(self.phrases.at[w], self.phrases.at[w + 1])]).tolist()
        return count, spans, items


def placed(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words with their places in the bytes of the text."""
    if not spans:
        return []
    where = [m.span() for m in re.finditer(b"[^ ]+", text_bytes(text).translate(WORDS))]
    return [{"first": a, "last": b - 1, "start": where[a][0], "end": where[b - 1][1]} for a, b in spans]


def searched(df: DataFrame, phrases: Phrases, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``spans`` and ``items`` of one block of test items."""
    shared = df.sparkSession.sparkContext.broadcast(phrases)
    schema = df.select(*keep, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<long>").alias("items")).schema
    types = {"n_words": pa.int64(), "items": pa.list_(pa.int64()), "spans": pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[pa.RecordBatch, list[int]]]) -> Iterator[pa.RecordBatch]:
            count, spans, items = shard.hits()
            texts = list(shard.slot)
            where = {i: placed(texts[i], s) for i, s in enumerate(spans) if s}
            for lone, slots in parts:
                own = {"n_words": [count[i] for i in slots], "spans": [where.get(i, []) for i in slots], "items": [items[i] for i in slots]}
                yield pa.RecordBatch.from_arrays([*lone.columns, *(pa.array(own[k], types[k]) for k in ("n_words", "spans", "items"))], names=schema.names)

        shard, parts = Shard(shared.value), []
        for b in sliced(it):
            slots = [shard.add(t) for t in b.column(b.num_columns - 1).to_pylist()]
            parts.append((b.select(list(range(b.num_columns - 1))), slots))
            if shard.size > SHARD:
                yield from out(parts)
                shard, parts = Shard(shared.value), []
        if parts:
            yield from out(parts)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def pieces(items: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """Distinct rows ``item, words`` (space-joined bytes): items in pieces of a bounded number of windows; none for items without words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(t)
                cut = [b" ".join(words[lo : lo + PIECE + window - 1]) for lo in range(0, max(1, len(words) - window + 1), PIECE)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["item", "words"])

    return items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("__text")).mapInArrow(run, "item long, words binary").distinct()


def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of several blocks (last columns: lists of spans and of items) with spans that overlap or touch made one."""
    for b in it:
        spans, items = [], []
        for row, held in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            one: list[dict[str, int]] = []
            for s in sorted((s for x in row or [] for s in x), key=lambda s: (s["first"], s["last"])):
                if one and s["first"] <= one[-1]["last"] + 1:
                    if s["last"] > one[-1]["last"]:
                        one[-1] |= {"last": s["last"], "end": s["end"]}
                else:
                    one.append(dict(s))
            spans.append(one)
            items.append(sorted({i for x in held or [] for i in x}))
        kinds = b.schema.field(b.num_columns - 2).type.value_type, b.schema.field(b.num_columns - 1).type.value_type
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(spans, kinds[0]), pa.array(items, kinds[1])], names=b.schema.names)


def leaks(df: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Where windows of test items occur in texts.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Returns for each
    row the columns ``keep``, ``n_words``, ``spans`` (merged runs of hit words: first and last word,
    start and end byte in the UTF-8 text) and ``items`` (ascending keys of the items with occurring
    windows). Null and empty texts have no words, and items without words no windows; items with
    a null key hit words but aren't named; rows that repeat an item's key are one item. Repeated rows of
    ``df`` stay; an empty table gives no rows; other columns have no part. Items of more than ``block`` bytes take several
    passes over the texts, which are then written to the shared folder once with row numbers.
    """
    rows = materialise(pieces(items, window, item_key, item_text), "leak-items")
    n = max(1, -(-int(rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // block))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(n))

    def phrases(i: int) -> Phrases:
        own = rows if n == 1 else rows.where(part == i)
        return Phrases([(r["item"], bytes(r["words"]).split()) for r in own.collect()], window)

    if n == 1:
        return searched(df, phrases(0), list(keep), text)
    numbered = materialise(df.select(F.monotonically_increasing_id().alias("__row"), *keep, F.col(text).alias("__text")), "leak-texts")
    passes = [materialise(searched(numbered, phrases(i), ["__row", *keep] if i == 0 else ["__row"], "__text"), "leak-found") for i in range(n)]
    found = passes[0].select("__row", "spans", "items")
    for p in passes[1:]:
        found = found.unionByName(p.where("size(spans) > 0").select("__row", "spans", "items"))
    one = found.groupBy("__row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    joined = passes[0].select("__row", *keep, "n_words").join(one, "__row").select(*keep, "n_words", "spans", "items")
    return joined.mapInArrow(merged, passes[0].select(*keep, "n_words", "spans", "items").schema)


def without_leaks(df: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", **options: object) -> DataFrame:
    """The columns ``keep`` with ``text`` less the spans of ``leaks`` and ``n_removed``, the bytes that went. A null text stays null."""
    found = leaks(df.withColumn("__whole", F.col(text)), items, keep=(*keep, "__whole"), text=text, **options)
    schema = found.select(*keep).schema.add(text, "string").add("n_removed", "long")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            texts, gone = [], []
            for t, spans in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                raw = text_bytes(t)
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                texts.append(None if t is None else kept.decode("utf-8", "surrogatepass"))
                gone.append(len(raw) - len(kept))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=schema.names)

    return found.select(*keep, "__whole", "spans").mapInArrow(cut, schema)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that windows of the benchmark hit, and the items they belong to. See ``leaks``."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


#: The same in SQL: windows as strings, met as strings.
OP11_SQL = r"""
    WITH words AS (
           SELECT 'd' AS side, doc_id AS id, row_number() OVER (ORDER BY doc_id, text) AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
           UNION ALL
           SELECT 'b', item_id, row_number() OVER (ORDER BY item_id, text), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
         windows AS (
           SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
           FROM words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE side = 'b' AND len(w) > 0),
         starts AS (
           SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
           FROM words, unnest(range(1, len(w) + 1)) AS t(i), (SELECT DISTINCT n FROM windows) AS k(n) WHERE side = 'd' AND i + n - 1 <= len(w)),
         met AS (SELECT r, i, windows.n, windows.id AS item FROM starts JOIN windows ON starts.s = windows.s AND starts.n = windows.n),
         hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM met, unnest(range(0, n)) AS t(k) GROUP BY r),
         named AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item::VARCHAR))), ',') AS items FROM met GROUP BY r)
    SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r) WHERE side = 'd'
"""
