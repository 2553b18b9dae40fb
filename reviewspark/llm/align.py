"""Operator 12: alignment of two tokenizers by the bytes where tokens of both end.

Texts are cut before a space or line feed that follows a character which is no white space: no token of either
vocabulary reaches over such a place (``Aligner`` checks the second one's pieces), so the parts are encoded alike
wherever they stand. Parts that a worker has not met yet are encoded together. Packed bitsets mark
the bytes where tokens end; their AND gives the shared cuts; population counts before a cut give the number
of tokens of either side (rank), and the places of set bits the cuts themselves (select).
Between two cuts lies a group, whose tokens are all linked.

How many documents hold a pair of ids linked is counted in blocks of documents first; the counts of its
pairs come back to each block, which adds them up for its documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewspark.llm.bpe import rounds
from reviewspark.llm.common import materialise, sliced, table
from reviewspark.llm.decontam import ranges

#: Where texts are cut.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Parts that a worker remembers, and how many of them at most when it makes room.
CACHE, KEPT = 400_000, 200_000
#: Characters of a text that are cut at once, and of new parts that are encoded at once.
STRETCH, FRESH = 4 << 20, 1 << 16
#: Bytes of text in a block, unless one document is longer.
BLOCK = 6 << 20
ID = 32
LOW = (1 << ID) - 1


def byte_levels() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bitset:
    """Marked places of a sequence of bytes, eight to a byte."""

    def __init__(self, n: int, ends: np.ndarray | None = None, packed: np.ndarray | None = None) -> None:
        self.n = n
        if packed is None:
            marks = np.zeros(n // 64 * 64 + 64, np.uint8)
            marks[ends] = 1
            packed = np.packbits(marks, bitorder="little").view("<u8")
        self.words = packed

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.n, packed=self.words & other.words)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Bits set up to place i, itself included."""
        before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        mask = np.uint64(2**64 - 1) >> (np.uint64(63) - (i & 63).astype(np.uint64))
        return before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class Aligner:
    """Encodes parts with both tokenizers, aligns them and remembers the outcome. Not shared between processes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        model = pb.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        if any(re.search("[^▁]▁|\n", p.piece) for p in model.pieces):
            raise ValueError("a piece of the second vocabulary reaches over a cut")
        model.normalizer_spec.add_dummy_prefix = False  # the text comes with its space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        level = byte_levels()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        a_bytes = {i: t.encode() if i in special else bytes(level[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        b_bytes = {i: bytes([int(p.piece[3:5], 16)]) if p.type == pb.ModelProto.SentencePiece.BYTE else p.piece.replace("▁", " ").encode() for i, p in enumerate(model.pieces)}
        self.bytes = a_bytes, b_bytes
        self.size = tuple(np.array([len(x[i]) for i in range(len(x))], np.int64) for x in self.bytes)
        self.digits = np.array([len(str(i)) for i in range(max(map(len, self.bytes)))], np.int64)
        self.names = [f"{i}{c}" for i in range(len(self.digits)) for c in ",|;"]
        self.clear()

    def clear(self) -> None:
        """Forget all parts. Of a known part: numbers of tokens, groups and links (-1 tokens: bytes differ), its groups as text, and its pairs."""
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.counts: list[tuple[int, int, int, int]] = []
        self.pairs: list[bytes] = []
        self.table: np.ndarray | None = None
        self.used = np.zeros(0, np.int64)

    def use(self, parts: np.ndarray) -> None:
        """Note that a block has these parts, each once."""
        if len(self.used) < len(self.counts):
            self.used = np.concatenate([self.used, np.zeros(2 * len(self.counts) - len(self.used), np.int64)])
        self.used[parts] += 1

    def make_room(self) -> None:
        """Forget what one block alone had, and more if ``KEPT`` are left; a forgotten part is encoded again when it comes."""
        used = self.used[: len(self.counts)]
        many = np.flatnonzero(used > 1)
        stay = np.sort(many[np.argsort(-used[many], kind="stable")[:KEPT]]).tolist()
        name = list(self.known)
        old = name, self.text, self.counts, self.pairs
        self.clear()
        self.known = {old[0][i]: k for k, i in enumerate(stay)}
        self.text, self.counts, self.pairs = ([x[i] for i in stay] for x in old[1:])
        self.use(np.arange(len(stay)))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both sides, and whether the bytes of both are the text's."""
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text)
        raw = text.encode("utf-8", "replace")
        same = all(b"".join(map(t.__getitem__, x)) == raw for t, x in zip(self.bytes, (a, b), strict=True))
        return np.array(a, np.int64), np.array(b, np.int64), same

    def align(self, parts: list[str]) -> None:
        """Learn new parts that can stand one after another: each starts at a cut."""
        whole = "".join(parts)
        a, b, same = self.encode(whole)
        if not same and len(parts) > 1:
            for p in parts:
                self.align([p])
            return
        if not same:
            self.keep(parts[0], (-1, 0, 0, 0), "", b"")
            return
        ends = np.cumsum(self.size[0][a]) - 1, np.cumsum(self.size[1][b]) - 1
        n = int(ends[0][-1]) + 1
        marks = Bitset(n, ends[0]), Bitset(n, ends[1])
        cuts = (marks[0] & marks[1]).select()
        ua, ub = (np.concatenate([[0], m.rank(cuts)]) for m in marks)
        na, nb = np.diff(ua), np.diff(ub)
        # Every link: the group's tokens of one side, for each of the other.
        first = np.repeat(np.arange(len(a)), np.repeat(nb, na))
        second = ranges(np.repeat(ub[:-1], na), np.repeat(ub[1:], na))
        pairs = ((a[first] << ID) | b[second]).tobytes()
        links = np.concatenate([[0], np.cumsum(na * nb)])
        # The groups as text: each id with what follows it, the tokens of a group's two sides one after another.
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[ua[1:] - 1], after_b[ub[1:] - 1] = 1, 2
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.repeat(ub[:-1], na)] = 3 * a + after_a
        row[np.arange(len(b)) + np.repeat(ua[1:], nb)] = 3 * b + after_b
        upto = np.concatenate([[0], np.cumsum(self.digits[row // 3] + 1)])
        text = "".join(map(self.names.__getitem__, row.tolist()))
        part = np.concatenate([[0], np.searchsorted(cuts, np.cumsum([len(p.encode("utf-8", "replace")) for p in parts]) - 1) + 1])
        at = ua[part], ub[part], part, links[part]
        counts = zip(*(np.diff(x).tolist() for x in at), strict=True)
        ends_of = upto[at[0] + at[1]].tolist()
        link = (8 * at[3]).tolist()
        for k, (p, c) in enumerate(zip(parts, counts, strict=True)):
            self.keep(p, c, text[ends_of[k] : ends_of[k + 1] - 1], pairs[link[k] : link[k + 1]])

    def keep(self, part: str, counts: tuple[int, int, int, int], text: str, pairs: bytes) -> None:
        self.known[part] = len(self.counts)
        self.counts.append(counts)
        self.text.append(text)
        self.pairs.append(pairs)
        self.table = None

    def parts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the numbers of the parts of a space and the text, all known from now on; a null or empty text has none."""
        rows = [[p for some in stretches(" " + t) for p in CUT.split(some)] if t else [] for t in texts]
        known = self.known
        held, size = [], 0
        for p in dict.fromkeys(p for row in rows for p in row if p not in known):
            if p[-1].isspace():  # what follows it could join it
                self.align([p])
                continue
            held.append(p)
            size += len(p)
            if size > FRESH:
                self.align(held)
                held, size = [], 0
        if held:
            self.align(held)
        return [np.fromiter(map(known.__getitem__, row), np.int64, len(row)) for row in rows]

    def tables(self) -> np.ndarray:
        """Counts of all known parts, a row each."""
        if self.table is None:
            self.table = np.array(self.counts, np.int64).reshape(-1, 4)
        return self.table

    def pairs_of(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some parts one after another, and where each part's start."""
        held = [self.pairs[i] for i in parts.tolist()]
        return np.frombuffer(b"".join(held), np.int64), np.cumsum([0, *[len(x) // 8 for x in held]])


def stretches(text: str) -> Iterator[str]:
    """A long text in stretches that end at cuts."""
    lo = 0
    while len(text) - lo > STRETCH:
        m = CUT.search(text, lo + STRETCH)
        if not m:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


@lru_cache(2)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One aligner for all tasks of a worker process."""
    return Aligner(a_path, b_path)


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def unpack(z: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(z), kind)


def blocks_of(df: DataFrame, a_path: str, b_path: str, keep: list[str], text: str) -> DataFrame:
    """Blocks of documents: their own columns, which parts each has and how often, the parts' pairs, and of each pair the documents that hold it."""
    schema = "block long, docs binary, doc binary, part binary, times binary, start binary, link binary, pair binary, n binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def block(number: int, al: Aligner, lone: list[pa.RecordBatch], docs: list[np.ndarray]) -> pa.RecordBatch:
        counts = al.tables()
        rows = []
        for i, p in enumerate(docs):
            c = counts[p]
            if not len(p) or (c[:, 0] < 0).any():
                docs[i] = p[:0]
                rows.append((0, 0, 0, 0, ""))
            else:
                rows.append((*c.sum(0).tolist(), hashlib.sha256(";".join(map(al.text.__getitem__, p.tolist())).encode()).hexdigest()))
        own = pa.Table.from_batches(lone).combine_chunks()
        for name, values, kind in zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True):
            own = own.append_column(name, pa.array(values, kind))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(own)
        every = np.concatenate(docs)
        there = np.zeros(len(al.counts), bool)
        there[every] = True
        parts, which = np.flatnonzero(there), (np.cumsum(there) - 1)[every]
        al.use(parts)
        n = max(1, len(parts))
        cell, times = np.unique(np.repeat(np.arange(len(docs)), [len(p) for p in docs]) * n + which, return_counts=True)
        doc, part = cell // n, cell % n
        held, start = al.pairs_of(parts)
        pair, link = np.unique(held, return_inverse=True)
        # Documents of each pair: of all pairs of a document's parts, each once.
        found = np.zeros(len(pair), np.int64)
        for lo in range(0, len(doc), 20_000):  # bounded, and never within a document
            lo, hi = (np.searchsorted(doc, doc[x]) if x < len(doc) else len(doc) for x in (lo, lo + 20_000))
            if lo < hi:
                own_links = link[ranges(start[part[lo:hi]], start[part[lo:hi] + 1])]
                each = np.repeat(doc[lo:hi], np.diff(start)[part[lo:hi]]) * max(1, len(pair)) + own_links
                found += np.bincount(np.unique(each) % max(1, len(pair)), minlength=len(pair))
        cells = [number, sink.getvalue().to_pybytes(), *(pack(x) for x in (doc.astype(np.uint32), part.astype(np.uint32), times.astype(np.uint32), start.astype(np.uint32), link.astype(np.uint32), pair, found.astype(np.uint32)))]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al = aligner_of(a_path, b_path)
        first, done = TaskContext.get().partitionId() << 36, 0
        lone, docs, held = [], [], 0
        for b in sliced(it, 100):
            rest = b.select(list(range(b.num_columns - 1)))
            texts = b.column(b.num_columns - 1).to_pylist()
            for some in rounds([len(t or "") for t in texts]):
                more = sum(len(t or "") for t in texts[some])
                if docs and (held + more > BLOCK or len(al.known) > CACHE):
                    yield block(first + done, al, lone, docs)
                    lone, docs, held, done = [], [], 0, done + 1
                    if len(al.known) > CACHE:
                        al.make_room()
                lone.append(rest.slice(some.start, some.stop - some.start))
                docs += al.parts(texts[some])
                held += more
        if docs:
            yield block(first + done, al, lone, docs)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def pair_rows(blocks: DataFrame) -> DataFrame:
    """``block, a, b, n``: pairs of ids of each block with the number of its documents that hold them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 1):
            for number, pair, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, n = unpack(pair, "<i8"), unpack(n, "<u4").astype(np.int64)
                for lo in range(0, len(p), 100_000):
                    some = p[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array((some >> ID).astype(np.int32)), pa.array((some & LOW).astype(np.int32)), pa.array(n[lo : lo + 100_000])], names=["block", "a", "b", "n"])

    return blocks.select("block", "pair", "n").mapInArrow(run, "block long, a int, b int, n long")


def aligned(df: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Alignment of two tokenizations of every whole text.

    The first tokenizer (a ``tokenizers`` file of a byte-level vocabulary) takes a space and the text, the
    second (a sentencepiece model that adds the space itself) the text. Returns the columns ``keep`` and
    ``n_a, n_b, n_groups, n_links``, ``n_best`` (links whose pair is held by most documents of all
    pairs of its first id, ties included), ``count_sum`` (documents that hold the pair, over all links)
    and ``groups_sha256``. Null and empty texts, and those whose tokens don't give the text back, have no tokens:
    zeros and ''. Each row is a document, repeated ones too; an empty table gives no rows; other columns have no part.
    """
    blocks = materialise(blocks_of(df, a_path, b_path, list(keep), text), "align-blocks")
    rows = pair_rows(blocks)
    counts = rows.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    back = rows.join(counts, ["a", "b"]).select("block", F.shiftleft(F.col("a").cast("long"), ID).bitwiseOR(F.col("b").cast("long")).alias("pair"), "count", "best")
    schema = df.select(*keep).schema
    for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        schema = schema.add(c, "long")
    schema = schema.add("groups_sha256", "string")

    def total(doc: pa.Table, pair: pa.Table) -> pa.Table:
        row = {c: doc.column(c)[0].as_py() for c in doc.column_names}
        with pa.ipc.open_stream(row["docs"]) as r:
            own = r.read_all()
        at, part, times, start, link = (unpack(row[c], "<u4").astype(np.int64) for c in ("doc", "part", "times", "start", "link"))
        known = unpack(row["pair"], "<i8")
        count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        where = np.searchsorted(known, pair.column("pair").to_numpy())
        count[where] = pair.column("count").to_numpy()
        best[where] = pair.column("best").to_numpy()
        for name, each in (("n_best", best), ("count_sum", count)):
            upto = np.concatenate([[0], np.cumsum(each[link])])
            of_part = upto[start[1:]] - upto[start[:-1]]
            of_doc = np.zeros(own.num_rows, np.int64)
            np.add.at(of_doc, at, times * of_part[part])
            own = own.append_column(name, pa.array(of_doc))
        return own.select(schema.names)

    return blocks.drop("n").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(total, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of all documents in two vocabularies. See ``aligned``."""
    import public_tokenizers as P

    return aligned(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
