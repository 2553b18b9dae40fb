"""Operator 5: MinHash document fingerprints, banded near-duplicate joins and Jaccard checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import LOWER, MULT, materialise, mix, prefix_hash, range_cuts, range_of, sliced, span_hash, table, table_of_bytes, text_bytes, word_bounds
from reviewspark.llm.simhash import set_rows, verified_links
from reviewspark.operators.graph import connected_components

#: Hash permutations of a fingerprint, each kept as one byte.
PERMUTATIONS = 128
SHINGLE = 5
BANDS = 32
CHUNK = 1 << 18
#: Bytes of text in a range of keys.
RANGE = 64 << 20
_BYTES = table_of_bytes(5)
_RNG = np.random.default_rng(55)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_hashes(texts: list[bytes], words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all word shingles of some texts, and the text that each belongs to.

    A text with fewer words is one shingle; one without words has none. A-Z count as a-z.
    """
    data = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    start, end = word_bounds(data)
    h = mix(span_hash(prefix_hash(data, _BYTES), start, end))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    n = len(h) - words + 1
    if n > 0:
        s = h[:n].copy()
        for j in range(1, words):
            s = s * MULT + h[j : j + n]
        same = doc[:n] == doc[words - 1 :]
        s, of = s[same], doc[:n][same]
    else:
        s, of = h[:0], doc[:0]
    count = np.bincount(doc, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        lo = np.searchsorted(doc, few)
        extra = [int(np.bitwise_xor.reduce(mix(h[a : a + count[d]] + np.arange(1, count[d] + 1, dtype=np.uint64)))) for a, d in zip(lo, few, strict=True)]
        s, of = np.concatenate([s, np.array(extra, np.uint64)]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        s, of = s[order], of[order]
    return mix(s) >> np.uint64(32), of


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 32-bit minima for each text; all ones without words."""
    out = np.full((len(texts), PERMUTATIONS), 2**32 - 1, np.uint32)
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        x, of = shingle_hashes(texts[at:to])
        if len(x):
            kinds, first = np.unique(of, return_index=True)
            for p in range(PERMUTATIONS):
                out[at + kinds, p] = np.minimum.reduceat((x * _A[p] + _B[p]) >> np.uint64(32), first)
        at = to
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints (rows of bytes), less chance agreement."""
    return np.clip(((a == b).mean(1) - 1 / 256) / (1 - 1 / 256), 0, 1)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The last byte of each minimum."""
    return (signatures(texts) & np.uint32(255)).astype(np.uint8)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt to ranges of the key, each range followed by the row that comes next in the whole table.

    Ranges hold about ``RANGE`` bytes of text; the first row of each is repeated (``halo``) at the end
    of the one before, and the very first at the end of the last. Only cuts and one key a range come
    to the driver. Rows with one key are one range, however many: sorted (with spill) and streamed.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text") + 100
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    cuts = range_cuts(docs, "key", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE)), size)
    dealt = docs.withColumn("part", range_of("key", cuts))
    firsts = dealt.groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull(), "key")).alias("f")).select("part", "f.key").orderBy("part").collect()
    target = [(firsts[(i + 1) % len(firsts)]["key"], firsts[i]["part"]) for i in range(len(firsts))]
    named = spark.createDataFrame(target, "first long, to int")  # a row a range
    halo = dealt.join(F.broadcast(named), F.col("key").eqNullSafe(F.col("first"))).select("key", "text", F.col("to").alias("part"))
    rows = dealt.withColumn("halo", F.lit(0)).unionByName(halo.withColumn("halo", F.lit(1)))
    return rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "halo", F.col("key").asc_nulls_first(), "text")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has its last half (rounded down) replaced by as many first characters of the
    next document in ascending key order, the last being followed by the first. Rows with equal keys
    follow each other by text, nulls come first, a null text is empty, a lone row follows itself.
    Repeated rows come out as often as they went in; an empty table gives no rows; other columns have no part.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[tuple] = []
        for b in sliced(it):
            rows = carry + list(zip(*(b.column(c).to_pylist() for c in ("part", "halo", "key", "text")), strict=True))
            carry = rows[-1:]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
            for lo in range(0, len(pairs), 128):
                some = pairs[lo : lo + 128]
                texts = [x[3] for x, _ in some]
                edited = [t[: len(t) - len(t) // 2] + y[3][: len(t) // 2] for t, (_, y) in zip(texts, some, strict=True)]
                raw = [text_bytes(t) for t in edited]
                own = fingerprints([text_bytes(t) for t in [*texts, some[-1][1][3]]])
                nxt = own[1:].copy()
                for i, (x, y) in enumerate(zip(some, some[1:], strict=False)):  # pairs of two ranges
                    if x[1] != y[0]:
                        nxt[i] = fingerprints([text_bytes(x[1][3])])[0]
                own, edit = own[:-1], fingerprints(raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in some], pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                        pa.array([r.tobytes().hex() for r in own]),
                        pa.array([r.tobytes().hex() for r in edit]),
                        pa.array(likeness(own, edit)),
                        pa.array(likeness(own, nxt)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, key, text).mapInArrow(run, schema)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Class of near-duplicate texts for each row: ``key, class_id`` (the smallest key of the class).

    Equal texts are one node. The nodes of a bucket (one band of their signatures is equal) that aren't joined yet
    meet in tiles; those whose shingle sets have Jaccard similarity ``threshold`` or more join classes.
    Buckets are aggregated, never paired, and those with the same nodes count once. A null text is
    empty and joins other empty ones; null keys are left out of links but kept as their own rows.
    """
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sha = F.sha2("text", 256)
    nodes = docs.where("key is not null").groupBy(sha.alias("sha")).agg(F.min("key").alias("node"))
    first = docs.withColumn("sha", sha).join(nodes, "sha").where("key = node").dropDuplicates(["node"]).select("node", "text")

    def bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            sig = signatures([text_bytes(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, BANDS, -1)
            h = np.zeros((b.num_rows, BANDS), np.uint64)
            for j in range(sig.shape[2]):
                h = mix(h * MULT + sig[:, :, j].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(h.view(np.int64).ravel())], names=["node", "band"])

    keyed = first.mapInArrow(bands, "node long, band long")
    # Buckets that hold the same nodes count once.
    buckets = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    buckets = buckets.groupBy("n", "low", "sum").agg(F.min("band").alias("band"))
    groups = materialise(keyed.join(buckets.select("band"), "band", "left_semi").select(F.col("band").alias("group"), "node"), "minhash-groups")
    some = first.join(groups.select("node").distinct(), "node", "left_semi")
    sets = materialise(set_rows(some, SHINGLE, "node", "text", True).select(F.col("key").alias("node"), "fp0", "fp1", "hashes"), "minhash-sets")
    classes = connected_components(verified_links(sets, groups, 128, threshold))
    return (
        docs.withColumn("sha", sha).join(nodes, "sha", "left").join(classes, "node", "left").select(F.col("key").alias(key), F.coalesce("component", "node").alias("class_id"))
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint all documents and their edited texts. See ``edited_fingerprints``."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
