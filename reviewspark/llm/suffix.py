"""Operator 9: removal of long repeated byte strings by merging front-coded sorted suffix runs.

The merge finds which suffixes repeat, by their first ``PREFIX`` bytes; the strings around those are
then judged by their hashes, which is cheaper than merging common prefixes of the whole length.
A string of ``length`` bytes is told by sparse suffixes: the first ``PREFIX`` bytes at those
positions whose hash is the least in some window of the string. Equal strings have equal such
positions, so a string can only repeat where a sparse suffix repeats.

1. Each block of documents sorts its sparse suffixes (a run), front-codes them and sends them to
   ranges of the suffix order, cut at sampled suffixes.
2. Each range merges its runs with a loser tree that keeps common prefixes, so that no known prefix
   is compared again; suffixes that occur twice anywhere are told back to their blocks.
3. Only strings around repeated suffixes are candidates. Neighbouring candidates with the same
   suffix are a stretch; blocks tell 96-bit hashes of their stretches, dealt by suffix. A stretch
   that occurs twice repeats as a whole.
4. Hashes of the single strings of the other stretches are told in the same way, and for suffixes
   with different stretches those of one copy of each that is known to repeat: the exact check.
5. Blocks remove what the repeated strings cover.

Every exchange is aggregated within a block first, so copies and hot passages cost a row a block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import forget, materialise, mix, prefix_hash, scratch, sliced, small, span_hash, table, table_of_bytes, text_bytes, word_bounds, word_hashes

PREFIX = 100
#: Bytes of text in a block, unless one document is longer.
BLOCK = 2 << 20
#: String starts worked on at once; no stretch goes on over a multiple of it.
SEGMENT = 1 << 18
#: String starts of a window, whose arrays stay near the processor.
STEP = 1 << 17
MOST = np.uint64(2**64 - 1)
#: Bytes of a hash that stands for a word where passages are counted in words.
WORD = 4
#: Words at the head of a suffix that are merged, and parts that copies of a text are looked up in.
WORDS_MERGED, SALTS = 12, 16
#: Bytes of text whose suffixes one range of the suffix order takes in.
RANGE = 128 << 20
_ONE, _TWO, _THREE, _FOUR = table_of_bytes(91), table_of_bytes(92), table_of_bytes(93), table_of_bytes(94)


def sliding(x: np.ndarray, w: int, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``op`` (least or greatest) over each w neighbours: entry i covers x[i:i+w]. Covers are doubled until two of them make one of w."""
    n, k = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * k <= w:
        x = op(x[:-k], x[k:])
        k *= 2
    return op(x[:n], x[w - k : w - k + n]) if k < w else x


class Window:
    """The strings of a block that start in [lo, hi), with the hashes of their prefixes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lo: int, hi: int, length: int, prefix: int) -> None:
        part = data[lo : min(len(data), hi + length - 1)]
        self.lo, self.n = lo, max(0, min(hi - lo, len(part) - length + 1))
        w = length - prefix + 1
        if not self.n:
            return
        size = len(part) - prefix + 1
        prefixes = prefix_hash(part, _ONE)
        self.h = mix(span_hash(prefixes, slice(0, size), slice(prefix, prefix + size)))
        a, b = np.searchsorted(ends, [lo, lo + size - 1], side="right")
        left = np.repeat(ends[a : b + 1], np.diff(np.minimum(ends[a : b + 1], lo + size), prepend=lo)) - np.arange(lo, lo + size)  # to the document's end
        self.h[left < prefix] = MOST
        self.least = sliding(self.h, w, np.minimum)[: self.n]
        self.valid = (left >= length)[: self.n]
        self.w = w

    def anchors(self) -> np.ndarray:
        """Positions that are the least of a string."""
        if not self.n:
            return np.zeros(0, np.int64)
        pad = np.zeros(self.w - 1, np.uint64)
        best = sliding(np.concatenate([pad, np.where(self.valid, self.least, np.uint64(0)), pad]), self.w, np.maximum)
        return np.flatnonzero((best == self.h[: len(best)]) & (best > 0)) + self.lo

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings whose least prefix is at one of the ``repeated`` positions, and its hash."""
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not self.n:
            return none
        h = np.full(len(self.h), MOST)
        a, b = np.searchsorted(repeated, [self.lo, self.lo + len(h)])
        if a == b:
            return none
        at = repeated[a:b] - self.lo
        h[at] = self.h[at]
        hit = np.flatnonzero((sliding(h, self.w, np.minimum)[: self.n] == self.least) & self.valid)
        return hit + self.lo, self.least[hit]


def windows(data: np.ndarray, ends: np.ndarray, length: int, prefix: int) -> Iterator[Window]:
    for lo in range(0, max(0, len(data) - length + 1), STEP):
        yield Window(data, ends, lo, lo + STEP, length, prefix)


def surroundings(data: np.ndarray, ends: np.ndarray, pos: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text that strings around ascending suffixes can cover, without the rest: where each piece starts in ``data``, what follows it in the text put together, and that text.

    The text put together is cut at the second array and at the ends of documents.
    """
    lo, hi = np.maximum(pos - (length - prefix), 0), np.minimum(pos + length, len(data))
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    lo, hi = lo[first], hi[np.append(first[1:] - 1, len(pos) - 1)]
    return lo, np.cumsum(hi - lo), np.concatenate([data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])


def unpack(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(z), np.uint8)


def blocks_of(df: DataFrame, keep: list[str], text: str, length: int, prefix: int, code: Callable[[Iterable[bytes]], Iterable[bytes]] | None = None) -> DataFrame:
    """Documents in blocks: kept columns, lengths, packed text, positions of sparse suffixes and, of those that differ, the sorted order.

    With ``code``, texts are turned into other bytes first, by the same worker: a second Python step in the stage would take a second worker a core.
    """
    schema = "block long, meta binary, ends binary, data binary, pos binary, which binary, rep binary, twice binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, done = TaskContext.get().partitionId() << 36, 0

        def block(rows: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
            nonlocal done
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.Table.from_batches(rows).combine_chunks())
            raw = b"".join(texts)
            data, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(t) for t in texts])
            found = [w.anchors() for w in windows(data, ends, length, prefix)]
            pos = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            at: dict[bytes, int] = {}
            each = [raw[p : p + prefix] for p in pos.tolist()]
            for p, s in zip(pos.tolist(), each, strict=True):
                at.setdefault(s, p)
            order = sorted(at)
            rank = {s: i for i, s in enumerate(order)}
            which = np.array([rank[s] for s in each], np.uint32)
            twice = np.bincount(which, minlength=len(order)) > 1
            cells = [first + done, sink.getvalue().to_pybytes(), ends.astype(np.int64).tobytes(), zstandard.compress(raw, 3), pos.astype(np.uint32 if len(raw) < 2**32 else np.int64).tobytes(), which.tobytes(), np.array([at[s] for s in order], np.int64).tobytes(), twice.tobytes()]
            done += 1
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=[x.split()[0] for x in schema.split(", ")])

        rows, texts, held = [], [], 0
        for b in sliced(it, 100):
            lone = b.select(list(range(b.num_columns - 1)))
            values = (x.as_py() for x in b.column(b.num_columns - 1))
            each = (t if isinstance(t, bytes) else text_bytes(t) for t in values)
            for i, t in enumerate(code(each) if code else each):
                if texts and held + len(t) > BLOCK:
                    yield block(rows, texts)
                    rows, texts, held = [], [], 0
                rows.append(lone.slice(i, 1))
                texts.append(t)
                held += len(t)
        if texts:
            yield block(rows, texts)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def matrix(data: np.ndarray, at: np.ndarray, prefix: int) -> np.ndarray:
    return data[at[:, None] + np.arange(prefix)]


def front_code(m: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Length of the prefix that each row shares with the one before, and all other bytes."""
    same = np.zeros(len(m), np.uint8)
    if len(m) > 1:
        same[1:] = (m[1:] != m[:-1]).argmax(1)
    return same, m[np.arange(m.shape[1]) >= same[:, None]].tobytes()


class Run:
    """A sorted run that is decoded as it is read: the string at its head, and what that shares with the last one taken."""

    def __init__(self, same: bytes, rest: bytes, prefix: int = PREFIX) -> None:
        self.same, self.rest, self.i, self.at, self.head, self.shared, self.prefix = same, rest, -1, 0, b"", 0, prefix
        self.step()

    def step(self) -> None:
        self.i += 1
        if self.i >= len(self.same):
            self.head, self.shared = None, -1
            return
        s = self.same[self.i]
        to = self.at + self.prefix - s
        self.head, self.shared, self.at = self.head[:s] + self.rest[self.at : to], s, to


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs: (run, place in it, length of the prefix shared with the string before).

    A loser tree; each loser keeps the prefix that it shares with the string that beat it. Of two
    heads the one that shares more with the last winner is less; only if both share as much are
    they compared, and then from there on.
    """
    leaves = 1 << max(0, (len(runs) - 1).bit_length())
    loser = [-1] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared length is set against the winner."""
        if a < 0 or runs[a].head is None:
            return b, a
        if b < 0 or runs[b].head is None:
            return a, b
        x, y = runs[a], runs[b]
        if x.shared != y.shared:
            return (a, b) if x.shared > y.shared else (b, a)
        h = x.shared
        p, q = x.head[h:], y.head[h:]
        if p == q:
            y.shared = y.prefix
            return a, b
        both = h + len(p) - ((int.from_bytes(p) ^ int.from_bytes(q)).bit_length() + 7) // 8
        if p < q:
            y.shared = both
            return a, b
        x.shared = both
        return b, a

    level = [i if i < len(runs) else -1 for i in range(leaves)]
    for r in runs:
        r.shared = 0 if r.head is not None else -1
    at = leaves
    while len(level) > 1:
        at //= 2
        won = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[at + i // 2] = lost
            won.append(w)
        level = won
    top = level[0]
    while top >= 0 and runs[top].head is not None:
        r = runs[top]
        yield top, r.i, r.shared
        r.step()
        node = (top + leaves) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def repeated(blocks: DataFrame, n: int, prefix: int) -> DataFrame:
    """Of each block, the places (in its sorted order) of sparse suffixes that occur twice anywhere."""
    total = max(1, blocks.count())

    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 4):
            for rep, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.frombuffer(rep, np.int64)
                if len(at):
                    m = matrix(unpack(z), at[len(at) // 32 :: max(1, len(at) // 16)], prefix)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in m])], names=["s"])

    share = min(1.0, 4 * n / total)
    some = sorted(r["s"] for r in (blocks if share >= 1 else blocks.sample(share, 3)).select("rep", "data").mapInArrow(sample, "s binary").collect())
    cuts = sorted({bytes(some[i * len(some) // n]) for i in range(1, n)}) if some else []

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 4):
            for block, rep, z, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.frombuffer(rep, np.int64)
                if not len(at):
                    continue
                data = unpack(z)
                raw = data.tobytes()

                class Keys:
                    def __len__(self) -> int:
                        return len(at)

                    def __getitem__(self, i: int, at: np.ndarray = at, raw: bytes = raw) -> bytes:
                        return raw[at[i] : at[i] + prefix]

                edges = [0, *[bisect_left(Keys(), c) for c in cuts], len(at)]
                out = []
                for p, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    if lo < hi:
                        same, rest = front_code(matrix(data, at[lo:hi], prefix))
                        out.append((p, block, lo, same.tobytes(), zstandard.compress(rest, 3), twice[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "base", "same", "rest", "twice"])

    def combine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] not in rows and rows:  # sorted by part
                    yield from merged(rows.popitem()[1])
                rows.setdefault(r[0], []).append(r)
        if rows:
            yield from merged(rows.popitem()[1])

    def merged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hits: list[list[int]] = [[] for _ in rows]
        last: tuple[int, int] | None = None
        open_ = False
        for run, i, shared in merge([Run(r[3], zstandard.decompress(r[4]), prefix) for r in rows]):
            if shared == prefix and last is not None:
                if not open_:
                    hits[last[0]].append(last[1])
                    open_ = True
                hits[run].append(i)
            else:
                open_ = bool(rows[run][5][i])
                if open_:
                    hits[run].append(i)
            last = run, i
        full = [(r[1], (np.array(h, np.uint32) + np.uint32(r[2])).tobytes()) for r, h in zip(rows, hits, strict=True) if h]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in full], pa.int64()), pa.array([x for _, x in full], pa.binary())], names=["block", "places"])

    runs = blocks.select("block", "rep", "data", "twice").mapInArrow(send, "part int, block long, base long, same binary, rest binary, twice binary")
    return runs.repartitionById(n, F.col("part")).sortWithinPartitions("part", "block").mapInArrow(combine, "block long, places binary")


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a further 32-bit hash of data[start:end], for ascending starts."""
    one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint32)
    for lo in range(0, len(data), SEGMENT):
        a, b = np.searchsorted(start, [lo, lo + SEGMENT])
        if a < b:
            part = data[lo : int(end[a:b].max())]
            one[a:b] = mix(span_hash(prefix_hash(part, _TWO), start[a:b] - lo, end[a:b] - lo))
            two[a:b] = mix(span_hash(prefix_hash(part, _THREE), start[a:b] - lo, end[a:b] - lo)) >> np.uint64(32)
    return one, two


def told(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """What was told to each block (a written table), put together in order: never more than the block has. Sent to all tasks if it is small."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order or column).alias("o"), F.col(column).alias("v"))))
    one = df.groupBy("block").agg(F.transform(cells, lambda x: x["v"]).alias(column))
    return F.broadcast(one) if small(df, [column]) else one


def dealt(part: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Of ascending part numbers, each part that occurs with its first place and the one after its last."""
    edges = np.searchsorted(part, np.arange(n + 1))
    return ((p, a, b) for p, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)) if a < b)


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in sliced(it, 4):
        yield from b.to_pylist()


def by_part(it: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each part of a task."""
    found: dict[int, list[dict]] = {}
    for r in rows_of(it):
        found.setdefault(r["part"], []).append(r)
    yield from found.values()


BIN, LONG, INT = pa.binary(), pa.int64(), pa.int32()
STRETCHES = {"block": LONG, "ends": BIN, "start": BIN, "size": BIN, "least": BIN, "one": BIN, "two": BIN, "region": BIN, "data": BIN}


def stretches(length: int, prefix: int):  # noqa: ANN201
    """Candidate stretches of each block: starts, numbers of strings, suffix and content hashes; and the text around them alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            data, ends = unpack(row["data"]), np.frombuffer(row["ends"], np.int64)
            which = np.frombuffer(row["which"], np.uint32)
            pos = np.frombuffer(row["pos"], np.uint32 if len(row["pos"]) == 4 * len(which) else np.int64).astype(np.int64)
            hit = np.zeros(int(which.max()) + 1, bool)
            hit[np.frombuffer(b"".join(row["places"]), np.uint32)] = True
            again = pos[hit[which]]
            begin, cut, near = surroundings(data, ends, again, length, prefix)
            shift = begin - np.concatenate([[0], cut[:-1]])  # from the text put together to the block's
            inside = np.searchsorted(begin, ends, side="right") - 1
            stops = (ends - shift[inside])[(inside >= 0) & (ends - shift[inside] < cut[inside])]
            again = again - shift[np.searchsorted(begin, again, side="right") - 1]
            found = [w.candidates(again) for w in windows(near, np.union1d(stops, cut), length, prefix)]
            here, least = np.concatenate([a for a, _ in found]), np.concatenate([m for _, m in found])
            at = here + shift[np.searchsorted(cut, here, side="right")]
            if not len(at):
                continue
            new = np.flatnonzero((np.diff(at) > 1) | (least[1:] != least[:-1]) | (at[1:] % SEGMENT == 0)) + 1
            first = np.concatenate([[0], new])
            start, size = at[first], np.diff(np.concatenate([first, [len(at)]]))
            end = start + size - 1 + length
            one, two = string_hashes(near, here[first], here[first] + size - 1 + length)
            cut = np.flatnonzero(start[1:] > np.maximum.accumulate(end)[:-1]) + 1
            lo = start[np.concatenate([[0], cut])]
            hi = np.maximum.reduceat(end, np.concatenate([[0], cut]))
            raw = data.tobytes()
            small = zstandard.compress(b"".join([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), 3)
            yield batch([(row["block"], row["ends"], start.tobytes(), size.tobytes(), least[first].tobytes(), one.tobytes(), two.tobytes(), np.stack([lo, hi]).tobytes(), small)], STRETCHES)

    return run


class Stretches:
    """The stretches of one block, decoded."""

    def __init__(self, row: dict) -> None:
        self.start, self.size = np.frombuffer(row["start"], np.int64), np.frombuffer(row["size"], np.int64)
        self.least, self.one, self.two = (np.frombuffer(row[k], t) for k, t in (("least", np.uint64), ("one", np.uint64), ("two", np.uint32)))
        self.order = np.lexsort([self.two, self.one, self.least])
        m, a, b = self.least[self.order], self.one[self.order], self.two[self.order]
        new = np.concatenate([[True], (m[1:] != m[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.kinds = self.order[new]
        self.of = np.empty(len(self.order), np.int64)
        self.of[self.order] = np.cumsum(new) - 1
        self.count = np.bincount(self.of)

    def strings(self, row: dict, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings of the chosen stretches, and their hashes."""
        lo, hi = np.frombuffer(row["region"], np.int64).reshape(2, -1)
        start, size = self.start[chosen], self.size[chosen]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(start, size) + inside
        base = np.concatenate([[0], np.cumsum(hi - lo)[:-1]]) - lo
        near = at + base[np.searchsorted(lo, at, side="right") - 1]
        return at, *string_hashes(unpack(row["data"]), near, near + length)


def remove_repeats(df: DataFrame, keep: list[str], length: int = 400, text: str = "text", as_text: bool = False, places: bool = False, prefix: int = PREFIX, code: Callable[[Iterable[bytes]], Iterable[bytes]] | None = None) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    Texts are UTF-8 bytes (null: empty), strings never cross documents, and all are judged on the
    input. Returns the columns ``keep``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept`` (binary, or with ``as_text`` a string without the halves of cut characters; with
    ``places`` the starts and ends of the removed runs instead). Rows come out as often as they went in;
    an empty table gives no rows; columns other than ``keep`` and the text have no part. ``prefix``
    bytes of a suffix are merged: fewer are cheaper to exchange, but may repeat where strings don't.
    With ``code``, all this is about the bytes that it makes of the texts.
    """
    spark = df.sparkSession
    blocks = materialise(blocks_of(df, keep, text, length, prefix, code), "suffix-blocks")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() * BLOCK // RANGE))
    again_at = materialise(repeated(blocks, n, prefix), "suffix-places")
    around = blocks.select("block", "ends", "data", "pos", "which").join(told(again_at, "places"), "block")
    found = materialise(around.mapInArrow(stretches(length, prefix), ", ".join(f"{k} {'long' if t == LONG else 'binary'}" for k, t in STRETCHES.items())), "suffix-stretches")

    def send_stretches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            s = Stretches(row)
            k, twice = s.kinds, s.count > 1
            out = [(p, row["block"], s.least[k[a:b]].tobytes(), s.one[k[a:b]].tobytes(), s.two[k[a:b]].tobytes(), twice[a:b].tobytes()) for p, a, b in dealt(part_of(s.least[k], n), n)]
            yield batch(out, {"part": INT, "block": LONG, "least": BIN, "one": BIN, "two": BIN, "twice": BIN})

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Code of each stretch: 0 repeats, 1 repeats and speaks for its strings, 2 speaks for them (alone, it may repeat within itself)."""
        for rows in by_part(it):
            rows.sort(key=lambda r: r["block"])
            m, one, two, twice = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("least", np.uint64), ("one", np.uint64), ("two", np.uint32), ("twice", bool)))
            order = np.lexsort([two, one, m])
            m, one, two, twice = m[order], one[order], two[order], twice[order]
            group = np.concatenate([[True], m[1:] != m[:-1]])
            kind = group | np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            kind_of, group_of = np.cumsum(kind) - 1, np.cumsum(group) - 1
            again = (np.bincount(kind_of) + np.bincount(kind_of, twice) > 1)[kind_of]
            mixed = (np.bincount(group_of, kind) > 1)[group_of]
            code = np.empty(len(m), np.uint8)
            code[order] = np.where(again, np.where(mixed & kind, 1, 0), 2)
            at = 0
            for r in rows:
                size = len(r["two"]) // 4
                yield batch([(r["block"], r["part"], code[at : at + size].tobytes())], {"block": LONG, "part": INT, "codes": BIN})
                at += size

    sent = found.drop("data", "ends", "region").mapInArrow(send_stretches, "part int, block long, least binary, one binary, two binary, twice binary")
    codes = materialise(sent.repartitionById(n, F.col("part")).mapInArrow(judge, "block long, part int, codes binary"), "suffix-codes")
    judged = found.join(told(codes, "codes", "part"), "block")

    def send_strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            s = Stretches(row)
            code = np.frombuffer(b"".join(row["codes"]), np.uint8)[s.of]
            chosen = np.flatnonzero((code == 1) | (code == 2))
            if not len(chosen):
                continue
            _, one, two = s.strings(row, chosen, length)
            one, first, count = np.unique(one, return_index=True, return_counts=True)
            two, twice = two[first], count > 1
            out = [(p, row["block"], one[a:b].tobytes(), two[a:b].tobytes(), twice[a:b].tobytes()) for p, a, b in dealt(part_of(one, n), n)]
            yield batch(out, {"part": INT, "block": LONG, "one": BIN, "two": BIN, "twice": BIN})

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_part(it):
            one, two, hit = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("one", np.uint64), ("two", np.uint32), ("twice", bool)))
            order = np.lexsort([two, one])
            a, b = order[:-1], order[1:]
            same = (one[a] == one[b]) & (two[a] == two[b])
            hit[a[same]] = True
            hit[b[same]] = True
            at = 0
            for r in rows:
                size = len(r["two"]) // 4
                yield batch([(r["block"], r["part"], hit[at : at + size].tobytes())], {"block": LONG, "part": INT, "bits": BIN})
                at += size

    strings = judged.mapInArrow(send_strings, "part int, block long, one binary, two binary, twice binary")
    bits = materialise(strings.repartitionById(n, F.col("part")).mapInArrow(count, "block long, part int, bits binary"), "suffix-bits")

    def spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            s, ends = Stretches(row), np.frombuffer(row["ends"], np.int64)
            code = np.frombuffer(b"".join(row["codes"]), np.uint8)[s.of]
            whole = np.flatnonzero(code < 2)
            lo, hi = s.start[whole], s.start[whole] + s.size[whole] - 1 + length
            chosen = np.flatnonzero((code == 1) | (code == 2))
            if len(chosen) and row["bits"]:
                at, one, _ = s.strings(row, chosen, length)
                at = at[np.frombuffer(b"".join(row["bits"]), bool)[np.unique(one, return_inverse=True)[1]]]
                lo, hi = np.concatenate([lo, at]), np.concatenate([hi, at + length])
            if not len(lo):
                continue
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            doc = np.searchsorted(ends, lo, side="right")
            cut = np.flatnonzero((lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])) + 1
            first = np.concatenate([[0], cut])
            yield batch([(row["block"], np.stack([lo[first], np.maximum.reduceat(hi, first)]).tobytes())], {"block": LONG, "spans": BIN})

    removed = judged.join(told(bits, "bits", "part"), "block", "left").mapInArrow(spans, "block long, spans binary")
    final = blocks.select("block", "meta", "ends", *([] if places else ["data"])).join(removed, "block", "left")
    schema = df.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            ends = np.frombuffer(row["ends"], np.int64)
            lo, hi = np.frombuffer(row["spans"] or b"", np.int64).reshape(2, -1)
            raw, out, start = b"" if places else zstandard.decompress(row["data"]), [], 0
            place = np.searchsorted(np.searchsorted(ends, lo, side="right"), np.arange(len(ends) + 1))
            for d, end in enumerate(ends.tolist()):
                a, z = place[d], place[d + 1]
                gone = np.stack([lo[a:z], hi[a:z]], 1)
                edges = [start, *gone.ravel().tolist(), end]
                kept = (gone - start).tobytes() if places else b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                out.append((end - start, int((gone[:, 1] - gone[:, 0]).sum()), int(z - a), kept))
                start = end
            base = 0
            for m in pa.ipc.open_stream(row["meta"]).read_all().combine_chunks().to_batches():
                c = list(zip(*out[base : base + m.num_rows], strict=True))
                base += m.num_rows
                kept = pa.array([k.decode("utf-8", "ignore") for k in c[3]], pa.string()) if as_text else pa.array(c[3], BIN)
                yield pa.RecordBatch.from_arrays([*m.columns, *[pa.array(x, LONG) for x in c[:3]], kept], names=schema.names)

    return final.mapInArrow(finish, schema)


def word_codes(texts: Iterable[bytes]) -> Iterator[bytes]:
    """The words of each text, as hashes of ``WORD`` bytes."""
    texts = list(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    start, end = word_bounds(data)
    codes = (word_hashes(data, start, end, _FOUR) >> np.uint64(32)).astype(np.uint32)
    edges = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts]])).tolist()
    return (codes[a:z].tobytes() for a, z in zip(edges, edges[1:], strict=False))


def repeated_passages(df: DataFrame, keep: list[str], words: int = 51, text: str = "text") -> DataFrame:
    """``keep``, ``n_repeated_words`` and ``spans``: words of each text that are covered by ``words`` words in a row that also start anywhere else.

    Words are runs without ASCII white space, of any length in bytes; each stands as a hash of
    ``WORD`` bytes, so that so many words are one string of fixed length to ``remove_repeats``.
    ``spans`` holds the covered runs (pairs of places in the hashes). Rows come out as often as they
    went in; a null text is empty; an empty table gives no rows.
    """
    found = remove_repeats(df, keep, WORD * words, text, places=True, prefix=WORD * WORDS_MERGED, code=word_codes)
    return found.select(*keep, (F.col("n_removed") / WORD).cast("long").alias("n_repeated_words"), F.col("kept").alias("spans"))


def remove_passages(df: DataFrame, keep: list[str], words: int = 51, text: str = "text") -> DataFrame:
    """Remove every word covered by ``words`` words in a row that also start anywhere else: ``keep`` and ``kept``.

    See ``repeated_passages``; a null text becomes an empty one.
    """
    schema = df.select(*keep).schema.add("kept", "string")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 100):
            out = []
            for t, z in zip(b.column(len(keep)), b.column(len(keep) + 1), strict=True):
                raw, at = text_bytes(t.as_py()), 0
                gone = np.frombuffer(z.as_py() or b"", np.int64).reshape(-1, 2)
                kept = []
                if len(gone):
                    start = [*word_bounds(np.frombuffer(raw, np.uint8))[0].tolist(), len(raw)]
                    for lo, hi in zip((-(-gone[:, 0] // WORD)).tolist(), (gone[:, 1] // WORD).tolist(), strict=True):
                        kept.append(raw[at : start[lo]])
                        at = start[hi]
                out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.string())], names=schema.names)

    rows = df.select(*keep, F.col(text).alias("__whole"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__sha"))
    with scratch() as used:  # equal texts have equal runs: those found are looked up by the digest of the text
        runs = repeated_passages(rows, ["__sha"], words, "__whole").where("n_repeated_words > 0").groupBy("__sha").agg(F.min("spans").alias("spans"))
    known = materialise(runs, "suffix-runs")
    forget(df.sparkSession, used)
    known = F.broadcast(known) if small(known, ["__sha", "spans"]) else known
    return rows.join(known, "__sha", "left").select(*keep, "__whole", "spans").mapInArrow(cut, schema)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 400 bytes from all documents, and count the words of repeated passages of over 50 words.

    ``n_repeated_words`` is a further column: a passage of 51 words is mostly shorter than 400 bytes,
    and stays in the text here. Equal texts have equal counts, so counts are found by the digest of
    the text. See ``remove_repeats`` and ``repeated_passages``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    with scratch() as used:
        words = repeated_passages(docs, ["sha"]).where("n_repeated_words > 0").groupBy("sha").agg(F.max("n_repeated_words").alias("n_repeated_words"))
    known = materialise(words, "suffix-words")
    forget(spark, used)
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a text may have very many copies
    out = remove_repeats(docs, ["doc_id", "sha"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = out.select("doc_id", "sha", "salt", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return out.join(salted, ["sha", "salt"], "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_repeated_words", F.lit(0)).alias("n_repeated_words"))
