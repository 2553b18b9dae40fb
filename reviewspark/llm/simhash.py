"""Operator 8: SimHash fingerprints, and links between them by tiled exact comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewspark.llm.common import LOWER, materialise, sliced, table, text_bytes
from reviewspark.operators.graph import connected_components

#: Fingerprints of a tile: larger groups are cut, and each two tiles near enough are a unit of work.
TILE = 16384
#: Texts of a tile where shingle sets are compared, and bytes of their sets.
SET_TILE, SET_BYTES = 2048, 24 << 20
#: Tiled counts that are sent to all tasks, and parts that a hot group is met in beyond that.
FEW, SALTS = 100_000, 64
#: Rows of a tile that meet the others at once.
STRIP = 256
#: Bits that two sets of at most so many shingles may differ in besides the radius: few hashes give coarse majorities.
TINY, TINY_MORE = 8, 8


def fingerprint(data: bytes, words: int, wide: bool = False) -> tuple[int, ...]:
    """Majority bits of the shingle hashes of a text (one 64-bit word, or two if ``wide``).

    A-Z count as a-z; words are runs without ASCII white space; fewer words than a shingle are one
    shingle, none give zero. Hashes are XXH64 with seed 42, or 128-bit XXH3 if ``wide``.
    """
    import xxhash

    parts = data.translate(LOWER).split()
    if not parts:
        return (0, 0) if wide else (0,)
    text = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), (ends[min(words, len(parts)) - 1 :] - 1).tolist(), strict=True)
    if wide:
        digest = xxhash.xxh3_128_digest
        h = np.frombuffer(b"".join([digest(text[a:b], 42) for a, b in spans]), ">u8").astype("<u8").reshape(n, 2)
    else:
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(text[a:b], 42) for a, b in spans], "<u8").reshape(n, 1)
    bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
    whole = n // 128 * 128
    count = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        count += bits[:whole].reshape(-1, 128, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * count > n, bitorder="little").view("<u8").tolist())


def fingerprints(df: DataFrame, words: int = 4, wide: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp0, fp1, size`` of every whole text; ``fp1`` is 0 unless ``wide``, ``size`` counts shingles."""
    schema = df.select(key).schema.add("fp0", "long").add("fp1", "long").add("size", "long")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            fps = np.zeros((b.num_rows, 2), np.uint64)
            sizes = []
            for i, t in enumerate(b.column(1)):
                raw = text_bytes(t.as_py())
                fp = fingerprint(raw, words, wide)
                fps[i, : len(fp)] = fp
                sizes.append(max(0, len(raw.split()) - words + 1))
            signed = fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array(sizes, pa.int64())], names=schema.names)

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_pairs(fp: np.ndarray, size: np.ndarray, side: np.ndarray, own: np.ndarray, inner: bool, radius: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs in one unit of work, as two arrays of indices for each two strips of rows.

    ``fp`` has a row of 64-bit words for each fingerprint. Rows are sorted by population count, and
    strips whose counts differ by more than the radius never meet. Unless ``inner``, only rows of
    different ``side`` meet; of two rows at least one must be ``own``. ``ratio`` is the least ratio
    of sizes; with it, the radius grows by ``TINY_MORE`` where all sizes are tiny.
    """
    if ratio and size.max() <= TINY:
        radius += TINY_MORE
    pop = np.bitwise_count(fp).sum(1, dtype=np.int32)
    order = np.argsort(pop, kind="stable")
    f, p, z, sd, ow = fp[order], pop[order], size[order].astype(np.float64), side[order], own[order]
    for i in range(0, len(f), STRIP):
        to = np.searchsorted(p, p[min(i + STRIP, len(f)) - 1] + radius, side="right")
        for j in range(i, to, 4 * STRIP):
            x, y = slice(i, min(i + STRIP, len(f))), slice(j, min(j + 4 * STRIP, to))
            d = np.bitwise_count(f[x, None, 0] ^ f[None, y, 0])
            for w in range(1, f.shape[1]):
                d = d + np.bitwise_count(f[x, None, w] ^ f[None, y, w])
            a, b = np.nonzero(d <= radius)
            a, b = a + i, b + j
            ok = (a < b) & (ow[a] | ow[b])
            if not inner:
                ok &= sd[a] != sd[b]
            if ratio:
                ok &= np.minimum(z[a], z[b]) >= ratio * np.maximum(z[a], z[b])
            yield order[a[ok]], order[b[ok]]


def compare(fp: np.ndarray, *unit: object) -> tuple[np.ndarray, np.ndarray]:
    """The links of ``near_pairs``, reduced to a star from the first node of each connected group."""
    pairs = list(near_pairs(fp, *unit))
    a, b = (np.concatenate([x[i] for x in pairs]) for i in (0, 1))
    if not len(a):
        return a, b
    root = settle(len(fp), a, b)
    node = np.flatnonzero(root != np.arange(len(fp)))
    return root[node], node


def members(fp: np.ndarray, *unit: object) -> np.ndarray:
    """Rows of a unit of work that are near another."""
    there = np.zeros(len(fp), bool)
    for a, b in near_pairs(fp, *unit):
        there[a] = there[b] = True
    return np.flatnonzero(there)


def block_keys(radius: int, blocks: int) -> list[int]:
    """Masks of 64-bit fingerprints such that two within ``radius`` bits agree under one of them.

    Of ``blocks`` equal blocks at most ``radius`` differ, so some ``blocks - radius`` agree whole.
    """
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - radius)]


def hot_tiles(keyed: DataFrame) -> DataFrame:
    """For groups of more than a tile's rows: ``kind, key, pop``, the tiles of that population count and what each meets.

    The rows of a group are cut into tiles along their population counts, a count with more than a
    tile's rows into several. ``first`` and ``tiles`` number the tiles of a count; ``meets`` holds
    for each of them the tiles whose counts are within the radius.
    """
    n = keyed.groupBy("kind", "key", "pop", "reach").agg(F.count("*").alias("n"))
    group = Window.partitionBy("kind", "key")
    n = n.withColumn("total", F.sum("n").over(group)).where(F.col("total") > TILE)
    upto = F.sum("n").over(group.orderBy("pop"))
    cut = n.select("kind", "key", "pop", "reach", F.floor((upto - F.col("n")) / TILE).cast("int").alias("first"), F.floor((upto - 1) / TILE).cast("int").alias("last"))
    each = cut.select("kind", "key", "pop", F.explode(F.sequence("first", "last")).alias("tile"))
    span = each.groupBy("kind", "key", "tile").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    other = span.select("kind", "key", F.col("tile").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # A tile's row takes part wherever its own count, not just its tile's, is near enough.
    near = cut.join(other, ["kind", "key"]).where((F.col("lo2") <= F.col("pop") + F.col("reach")) & (F.col("hi2") >= F.col("pop") - F.col("reach")))
    return near.groupBy("kind", "key", "pop", "first", "last").agg(F.collect_list("other").alias("meets"))


def links(nodes: DataFrame, radius: int, blocks: int | None = None, ratio: float = 0.0, whole: bool = True) -> DataFrame:
    """Links ``src, dst`` between rows ``node, fp0, fp1, size`` that differ in ``radius`` bits or less.

    With ``blocks``, rows meet that agree on enough blocks of ``fp0`` (exact, no link is lost); with
    ``ratio``, rows meet whose sizes are in the same or neighbouring steps of that ratio. Groups of
    more than a tile's rows are cut into tiles along their population counts (``hot_tiles``), and
    every two tiles are a unit of work, so that a hot group is dealt over many tasks; tiles whose
    counts differ by more than the radius are never sent to each other. Each unit gives at most one
    link a row. If not ``whole``, ``src`` is the number of a unit of work instead, and ``dst`` a row that is near another there.
    """
    spark = nodes.sparkSession
    pop = (F.bit_count("fp0") + F.bit_count("fp1")).cast("int")
    if blocks:
        signed = [m - 2**64 if m >= 2**63 else m for m in block_keys(radius, blocks)]
        keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp0").bitwiseAND(F.lit(m)).alias("key"), F.lit(True).alias("own")) for i, m in enumerate(signed)])
    else:
        step = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.log(F.lit(1 / ratio)) + F.lit(1e-9)).cast("long")
        keys = F.array(F.struct(F.lit(0).alias("kind"), step.alias("key"), F.lit(True).alias("own")), F.struct(F.lit(0).alias("kind"), (step + 1).alias("key"), F.lit(False).alias("own")))
    reach = F.lit(radius) if blocks else F.lit(radius + TINY_MORE)
    keyed = nodes.withColumn("k", F.explode(keys)).select("node", "fp0", "fp1", "size", "k.*", pop.alias("pop"), reach.alias("reach"))
    hot = materialise(hot_tiles(keyed), "simhash-tiles")
    if hot.count() <= FEW:
        joined = keyed.join(F.broadcast(hot), ["kind", "key", "pop"], "left")
    else:  # too many to send to all: met in parts, so that no task takes in a hot group
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "key", "pop", "salt"], "left").drop("salt")
    own_tile = F.coalesce(F.col("first") + F.pmod(F.xxhash64("node"), F.col("last") - F.col("first") + 1).cast("int"), F.lit(0))
    dealt = (
        joined.withColumn("tile", own_tile)
        .withColumn("other", F.explode(F.coalesce("meets", F.array(F.lit(0)))))
        .select("kind", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "own", "node", "fp0", "fp1", "size")
    )
    unit = ["kind", "key", "i", "j"]
    width = 1 if blocks else 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def found(c: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            src, dst = [c[6][:0]], [c[6][:0]]
            fp = np.stack(c[7 : 7 + width], 1).view(np.uint64)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1 and not whole:
                    near = members(fp[a:b], c[9][a:b], c[4][a:b], c[5][a:b], c[2][a] == c[3][a], radius, ratio)
                    number = xxhash.xxh64_intdigest(np.array([c[k][a] for k in range(4)], np.int64).tobytes()) - 2**63
                    src.append(np.full(len(near), number, np.int64))
                    dst.append(c[6][a:b][near])
                elif b - a > 1:
                    x, y = compare(fp[a:b], c[9][a:b], c[4][a:b], c[5][a:b], c[2][a] == c[3][a], radius, ratio)
                    src.append(c[6][a:b][x])
                    dst.append(c[6][a:b][y])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

        held: list[np.ndarray] = []
        for batch in it:
            now = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in held[:4]])) + 1
            if len(new):
                edges = np.concatenate([[0], new])
                yield found(held, edges[:-1], edges[1:])
                held = [x[new[-1] :] for x in held]
        if held:
            yield found(held, np.array([0]), np.array([len(held[0])]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *unit).sortWithinPartitions(*unit).mapInArrow(run, "src long, dst long").distinct()


def components(df: DataFrame, words: int = 4, radius: int = 4, blocks: int | None = 5, wide: bool = False, ratio: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: ``key, fp0, fp1, size, component``.

    Equal fingerprints are one node; ``component`` is the smallest key that can be reached over links
    (null where all keys of it are null). Repeated rows stay. Null texts are empty; texts without words
    have fingerprint zero and are linked like any other. An empty table gives no rows; other columns
    have no part.
    """
    docs = materialise(fingerprints(df, words, wide, key, text).withColumnRenamed(key, "key"), "simhash")
    # Fingerprints stand for nodes by their hash row: the smallest key names each.
    nodes = docs.groupBy("fp0", "fp1").agg(F.min("key").alias("node"), F.min("size").alias("size"))
    known = materialise(nodes, "simhash-nodes")
    found = connected_components(links(known.where("node is not null"), radius, blocks, ratio))
    named = known.join(found, "node", "left").select("fp0", "fp1", F.coalesce("component", "node").alias("component"))
    return docs.join(named, ["fp0", "fp1"], "left").select(F.col("key").alias(key), "fp0", "fp1", "size", "component")


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct 128-bit hashes (two words each) of the shingles of a text, cut as for ``fingerprint``."""
    import xxhash

    parts = data.translate(LOWER).split()
    n = max(1, len(parts) - words + 1) if parts else 0
    kinds = {b" ".join(parts[i : i + words]) for i in range(n)}
    return np.frombuffer(b"".join(sorted(xxhash.xxh3_128_digest(k, 42) for k in kinds)), ">u8").astype("<u8").reshape(-1, 2)


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Majority bits of distinct shingles, as two signed words; none give zero."""
    if not len(hashes):
        return np.zeros(2, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")


def verified(fp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, inner: bool, radius: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows within the radius whose sorted sets have that Jaccard similarity, less those that close a ring.

    A pair whose rows are joined by links found before isn't looked at, since it can't change a group.
    """
    size = np.array([len(s) for s in sets])
    label, left, right = np.arange(len(fp)), [], []
    for a in range(len(fp) - 1):
        rest = slice(a + 1, len(fp))
        ok = (label[rest] != label[a]) & (np.minimum(size[a], size[rest]) >= (threshold - 1e-9) * np.maximum(size[a], size[rest]))
        if not inner:
            ok &= side[rest] != side[a]
        some = np.flatnonzero(ok) + a + 1
        near = np.bitwise_count(fp[some] ^ fp[a]).sum(1, dtype=np.int32) <= radius + TINY_MORE * (np.maximum(size[some], size[a]) <= TINY)
        for b in some[near].tolist():
            if label[a] == label[b]:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both and both >= threshold * (size[a] + size[b] - both):
                label[label == label[b]] = label[a]
                left.append(a)
                right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def verified_links(sets: DataFrame, groups: DataFrame, radius: int, threshold: float) -> DataFrame:
    """Links ``src, dst`` between texts that meet in a group, judged on their shingle sets.

    ``sets``: node, fp0, fp1 and hashes (sorted 64-bit words), one row a node; ``groups``: group, node, where a
    node may be in several. A group is cut into tiles of bounded rows and bytes, and every two of its tiles are a unit of work.
    """
    spark = sets.sparkSession
    held = sets.join(groups, "node")
    cut = F.greatest(F.ceil(F.count("*") / SET_TILE), F.ceil(F.sum(F.octet_length("hashes")) / SET_BYTES), F.lit(1)).cast("int")
    tiles = held.groupBy("group").agg(cut.alias("tiles"))
    dealt = (
        held.join(tiles, "group")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "fp0", "fp1", "hashes")
    )

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            fp = np.array([r[5:7] for r in rows], np.int64).view(np.uint64)
            node, side = np.array([r[4] for r in rows], np.int64), np.array([r[3] for r in rows])
            a, b = verified(fp, [np.frombuffer(r[7], np.uint64) for r in rows], side, rows[0][1] == rows[0][2], radius, threshold)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["src", "dst"])

        held: list[tuple] = []
        for b in sliced(it):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:3] != r[:3]:
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = ["group", "i", "j"]
    return materialise(dealt.repartition(n, *unit).sortWithinPartitions(*unit).mapInArrow(judge, "src long, dst long"), "copies-sure")


def set_rows(df: DataFrame, words: int, key: str, text: str, hashes: bool) -> DataFrame:
    """``key``, SHA-256 of the text, digest of the shingle set (d0, d1), fingerprint (fp0, fp1), ``size`` and, if asked for, half of each hash, sorted."""
    schema = df.select(F.col(key).alias("key")).schema.add("sha", "binary")
    for c in ("d0", "d1", "fp0", "fp1", "size"):
        schema = schema.add(c, "long")
    schema = schema.add("hashes", "binary") if hashes else schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in sliced(it):
            rows, half, sha = [], [], []
            for t in b.column(1):
                raw = text_bytes(t.as_py())
                s = shingle_set(raw, words)
                sha.append(hashlib.sha256(raw).digest())
                rows.append([*np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), 42), "<i8").tolist(), *set_fingerprint(s).tolist(), len(s)])
                half.append(np.sort(s[:, 0]).tobytes() if hashes else b"")  # enough to tell shingles apart
            c = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), *(pa.array(c[:, i]) for i in range(5)), *([pa.array(half, pa.binary())] if hashes else [])], names=schema.names)

    return df.select(F.col(key).alias("key"), F.col(text).alias("__text")).mapInArrow(run, schema)


def near_copies(df: DataFrame, words: int = 5, radius: int = 38, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of texts chained by Jaccard similarity ``threshold`` of their shingle sets: ``key, sha, component``, a row for each of ``df``.

    ``sha`` is the SHA-256 of the row's text. Equal sets are one node, whatever keys they have, and
    rows of one key with other texts are nodes of their own. Rows whose fingerprints of distinct shingles are within ``radius`` of 128 bits
    in some unit of work are judged there on the sets themselves, so that only verified links join texts.
    ``component`` is the smallest key reached (null where all are null); texts without words are equal.
    """
    docs = materialise(set_rows(df, words, key, text, False), "copies")
    nodes = docs.groupBy("d0", "d1", "fp0", "fp1", "size").agg(F.min("key").alias("first")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "copies-nodes")
    near = links(nodes.where("first is not null").select("node", "fp0", "fp1", "size"), radius, None, threshold - 1e-9, whole=False)
    groups = materialise(near.select(F.col("src").alias("group"), F.col("dst").alias("node")), "copies-groups")
    some = nodes.join(groups.select("node").distinct(), "node", "left_semi").select("d0", "d1", "node", "first")
    rows = df.join(some.select(F.col("first").alias(key)).distinct(), key, "left_semi")
    sets = set_rows(rows, words, key, text, True).join(some.withColumnRenamed("first", "key"), ["d0", "d1", "key"])
    sets = materialise(sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp0", "fp1", "hashes")]), "copies-members")
    sure = materialise(verified_links(sets, groups, radius, threshold), "copies-sure")
    found = connected_components(sure).join(nodes.select("node", "first"), "node")
    least = found.groupBy("component").agg(F.min("first").alias("least"))
    found = found.join(least, "component").select("node", "least")
    named = nodes.join(found, "node", "left").select("d0", "d1", F.coalesce("least", "first").alias("component"))
    return docs.join(named, ["d0", "d1"], "left").select(F.col("key").alias(key), "sha", "component")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint all documents and name the group of each. See ``components``."""
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
