"""Operator 1: packing token sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import sliced, table

#: Words a worker remembers; beyond it, new ones are encoded each time they occur.
CACHE = 500_000
#: Text encoded together, in characters.
ROUND = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Ids of texts under a tokenizer whose tokens never cross a space, with a memory of words."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def each(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, each encoded by itself."""
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, found, strict=True)}

    def many(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are letters only: each is one pre-token, so that its last id ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):
            return self.each(words)
        raw, at = ids.tobytes(), [0, *(cut * 4).tolist()]
        return {w: raw[a:b] for w, a, b in zip(words, at, at[1:], strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        rows = [(t if "Σ" in t else t.lower()).replace("\n", " ").split(" ") for t in texts]
        known = self.known
        fresh = set().union(*rows).difference(known)  # known is a dict, so that words are looked up one by one, not all that is known walked over
        # A mark after an ASCII letter is a pre-token of its own; after other letters it may join what they turn into.
        bare = {w: (w[:-1], w[-1]) if len(w) > 1 and w[-1] in ".,;:!?" and w[-2].isascii() and w[-2].isalpha() else (w, "") for w in fresh}
        need = {w for pair in bare.values() for w in pair if w not in known}
        plain = [w for w in need if w.isalpha()]
        made = self.many(plain) if plain else {}
        made |= self.each([w for w in need if w not in made])
        look = {**made, **{w: made.get(a, known.get(a)) + made.get(b, known.get(b)) for w, (a, b) in bare.items()}}
        brief = look if len(known) + len(look) > CACHE else [w for w in look if len(w) >= 64]
        known |= look  # none of these was known
        out = [b"".join(map(known.__getitem__, row)) for row in rows]
        for w in brief:
            del known[w]
        return out


@lru_cache(2)
def words_of(path: str) -> WordIds:
    """One tokenizer for all tasks of a worker process."""
    return WordIds(path)


def pieces(df: DataFrame, path: str, end_id: int, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cut each document's ids (and ``end_id`` after them) into pieces of at most ``size``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = words_of(path), np.uint32(end_id).astype("<u4").tobytes()

        def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
            out = []
            for k, x in zip(keys, ids.encode(texts), strict=True):
                x += end
                n, view = len(x) // 4, memoryview(x)
                out += [(k, s, min(size, n - s), zlib.crc32(view[4 * s : 4 * min(s + size, n)]), n) for s in range(0, n, size)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        keys, texts, held = [], [], 0
        for b in sliced(it):
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                if texts and held + len(t) > ROUND:
                    yield rows(keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(k)
                texts.append(t)
                held += len(t)
        if texts:
            yield rows(keys, texts)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def first_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, taken in the given order, each into the first bin with room.

    A tournament tree over the bins holds the largest free space below each node; a descent to the
    left wherever that has room finds the first fitting bin in logarithmic time.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    free = [size] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        i = 1
        while i < leaves:
            i *= 2
            if free[i] < n:
                i += 1
        bins.append(i - leaves)
        offsets.append(size - free[i])
        free[i] -= n
        i //= 2
        while i:
            best = free[2 * i] if free[2 * i] > free[2 * i + 1] else free[2 * i + 1]
            if free[i] == best:
                break
            free[i] = best
            i //= 2
    return bins, offsets


def pack(items: DataFrame, n_groups: int, size: int, seed: int = 17) -> DataFrame:
    """Pack pieces (columns of ``PIECES``) into sequences of at most ``size`` tokens.

    Each piece goes to one of ``n_groups`` groups at random (by a seeded hash of its values and its
    place in the input, so that repeated rows are spread too); first-fit decreasing runs in each group
    by itself, ties in length by document and start. Adds ``sequence_id`` (unique over groups) and
    ``offset``. Repeated rows are packed as often as they occur; an empty table gives no rows.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first")
        bins, offsets = first_fit(pdf.length.tolist(), size)
        return pdf.assign(sequence_id=pdf.grp * 2**31 + np.array(bins, np.int64), offset=np.array(offsets, np.int64)).drop(columns="grp")

    keyed = items.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_groups)))
    return keyed.groupBy("grp").applyInPandas(group, f"{PIECES}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, end_id: int = 2, size: int = 4096, group_docs: int = 2048) -> DataFrame:
    """Tokenize, cut and pack documents: rows of ``pack``.

    A null or empty text is one end token; a null id stays null; repeated rows are packed as often as
    they occur; an empty table gives no rows; columns other than id and text have no part.
    """
    n_groups = max(1, -(-df.count() // group_docs))
    return pack(pieces(df, path, end_id, size), n_groups, size)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens. See ``pack_documents``."""
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
