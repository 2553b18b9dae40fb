"""Operator 10: byte-level BPE encoding and decoding through a serialised sentencepiece model."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import sliced, table

#: Each byte is written as this character plus its value, so that every piece is plain text.
BASE = 0x4E00
#: Chunks and pre-tokens a worker remembers; beyond it, new ones are encoded once a round.
CACHE = 800_000
#: Pre-tokens that go through the model in one call.
GROUP = 200
#: Characters encoded, or bytes of ids decoded, together.
ROUND = 2_000_000
#: White space that not every regular-expression engine takes for such: texts with it go the slow way.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A Latin word, perhaps with a space before and a mark after it: one pre-token, or two.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-\u024f]+)([.,;:!?]?)").fullmatch
CHUNK = re.compile("[\t\n\r ]*[^\t\n\r ]+|[\t\n\r ]+")
#: Maps bytes read as Latin-1 to the characters of pieces.
_TABLE = {i: chr(BASE + i) for i in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model: piece i+1 is the token of rank order i, scored by its negative rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    t, n = m.trainer_spec, m.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(ranks) + 1, 0, -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        m.pieces.add(piece=token.decode("latin-1").translate(_TABLE), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    return m.SerializeToString()


class Codec:
    """Encodes and decodes with one vocabulary. Not shared between processes.

    Texts are encoded together: chunks and pre-tokens that are not remembered are gathered once each,
    and many pre-tokens go through one call of the model, between separators that no piece contains.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.order = np.array(sorted(ranks.values()), np.uint32)
        self.whole = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks)).encode
        self.known: dict[str, bytes] = {}
        size = np.zeros(int(self.order[-1]) + 1, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]
        self.size, self.start = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def merged(self, raws: list[bytes]) -> list[bytes]:
        """Ids of non-empty pre-tokens (UTF-8) as little-endian 32-bit integers."""
        out = []
        for lo in range(0, len(raws), GROUP):
            some = np.frombuffer(b"\xff".join(raws[lo : lo + GROUP]), np.uint8).astype("<u4")  # UTF-8 never holds this byte
            some[some == 255] = 256
            ids = np.array(self.model((some + np.uint32(BASE)).astype("<u4").tobytes().decode("utf-32-le")), np.int64)
            gaps = np.flatnonzero(ids == 0)
            at = [0, *(4 * (gaps - np.arange(len(gaps)))).tolist(), 4 * (len(ids) - len(gaps))]
            flat = self.order[ids[ids > 0] - 1].astype("<u4").tobytes()
            out += [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        rows = [([t] if RARE_SPACE.search(t) else CHUNK.findall(t)) if t else [] for t in texts]
        known = self.known
        fresh = {c for row in rows for c in row if c not in known}
        pieces, joint = set(), {}
        for c in fresh:
            if m := PLAIN(c):
                word, mark = m.groups()
                pieces.add(word)
                if mark:
                    pieces.add(mark)
                    joint[c] = word, mark
            else:
                parts = self.split(c)
                pieces.update(parts)
                if len(parts) > 1:
                    joint[c] = tuple(parts)
        rest, raws, made = [], [], []
        for p in pieces:
            if p not in known:
                made.append(p)
                raw = p.encode("utf-8", "replace")
                if raw in self.whole:
                    known[p] = self.whole[raw]
                else:
                    rest.append(p)
                    raws.append(raw)
        known.update(zip(rest, self.merged(raws), strict=True))
        known.update((c, b"".join(map(known.__getitem__, ps))) for c, ps in joint.items())
        out = [b"".join(map(known.__getitem__, row)) for row in rows]
        full = len(known) > CACHE
        for x in (*made, *joint):
            if full or len(x) >= 64:
                known.pop(x, None)
        return out

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = self.size[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.repeat(self.start[flat] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])].tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def rounds(sizes: list[int]) -> Iterator[slice]:
    """Slices of rows that together hold about ``ROUND``, or one row that holds more."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > ROUND:
            yield slice(lo, i)
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield slice(lo, len(sizes))


@lru_cache(2)
def codec_of(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker process."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of every whole text.

    Returns the columns ``keep``, ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit
    integers). A null or empty text has no ids. Other columns are ignored,
    repeated rows stay, an empty table gives no rows.
    """
    schema = df.select(*keep).schema.add("n_tokens", "long").add("ids", "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for b in sliced(it):
            texts = b.column(b.num_columns - 1).to_pylist()
            ids = [x for some in rounds([len(t or "") for t in texts]) for x in codec.encode_all(texts[some])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that ``ids`` stand for. Null ids give null."""
    schema = df.select(*[c for c in df.columns if c != ids], ids).schema.add("decoded", "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for b in sliced(it):
            held = b.column(b.num_columns - 1).to_pylist()
            out = [x for some in rounds([len(h or b"") for h in held]) for x in codec.decode_all([h or b"" for h in held[some]])]
            out = [None if h is None else x for h, x in zip(held, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return df.select(*[c for c in df.columns if c != ids], ids).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, decode the ids again and return digests of both. See ``encode``."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents"), path, P.PATTERN)
    return decode(ids, path, P.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
