"""Operator 7: nearest neighbours by cross-polytope hashing with multiprobe and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewspark.llm.common import materialise, sliced, table

TABLES = 6
PROBES = 20
#: Vectors of a bucket that one unit of work holds; larger buckets are cut by a hash.
CHUNK = 8192
#: Parts that equal vectors are first cut into.
SALTS = 16


def rotate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, after padding to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], n)
        h = 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def axes(unit: np.ndarray, table_no: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each unit vector in one table, nearest first."""
    r = rotate(unit, np.random.default_rng([table_no, 0]))
    return np.argsort(-np.concatenate([r, -r], 1), 1, kind="stable")[:, : max(probes, 1)].astype(np.int64)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: a key, and a vector that is neither null, empty nor zero and all finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & finite & F.exists(v, lambda x: x != 0)
    )


def raw_of(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes: 32-bit where that loses nothing, else 64-bit; the number of dimensions tells which."""
    small = x.astype(np.float32)
    exact = (small.astype(np.float64) == x).all(1)
    return [s.tobytes() if e else v.tobytes() for s, v, e in zip(small, x, exact, strict=True)]


def stacked(raws: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raws])


def packed(rows: DataFrame) -> DataFrame:
    """Rows ``id, v`` as ``id, dim, x`` (bytes)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 2000):
            vs = b.column(1).to_pylist()
            dims = np.array([len(v) for v in vs], np.int32)
            raws = [b""] * len(vs)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for i, r in zip(at.tolist(), raw_of(np.array([vs[i] for i in at])), strict=True):
                    raws[i] = r
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims), pa.array(raws, pa.binary())], names=["id", "dim", "x"])

    return rows.select("id", "v").mapInArrow(run, "id long, dim int, x binary")


def index_entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors ``dim, x`` of rows ``id, dim, x`` with the ``k + 1`` smallest keys of each.

    Equal vectors are told by a 128-bit hash, so that only hashes and keys are ranked; a vector that
    holds a third of all rows is cut down within each task before rows of it meet.
    """
    raw = rows.select("id", "dim", "x", F.xxhash64("dim", "x").alias("h0"), F.xxhash64(F.lit(7), "x", "dim").alias("h1"))
    few = raw.select("h0", "h1", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for group in (["h0", "h1", "salt"], ["h0", "h1"]):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    ids = few.groupBy("h0", "h1").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    once = raw.groupBy("h0", "h1").agg(F.min(F.struct("dim", "x")).alias("one"))
    return once.join(ids, ["h0", "h1"]).select("one.dim", "one.x", "ids")


def search(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The ``k`` nearest rows of ``df`` (Euclidean, in double precision) that the tables find for each query.

    Equal vectors are one entry of the index that names its ``k + 1`` smallest keys, which is all that
    a result can hold of them. Buckets and queries of a table meet in units of at most ``CHUNK``
    vectors; each unit gives its ``k`` nearest, reranked on the original vectors. A query for which fewer than
    ``k`` rows were found is compared with all rows, in the same units. One setting holds at every size.

    The query's own key is left out; ties go to the smaller key; vectors of other lengths never meet;
    rows whose key or vector is null, empty, zero or not finite take no part. A key that repeats with
    one vector counts once, with several it is a candidate by each and found by its nearest. An empty
    table gives no rows, and other columns have no part. Returns ``query_id, rank, vec_id, score``.
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = materialise(index_entries(packed(usable(df, key, vector)), k), "ann-entries")
    asked = materialise(packed(usable(queries, key, vector)).distinct().select("dim", "x", F.array("id").alias("ids")), "ann-queries")

    def deal(probes: int, kind: int):  # noqa: ANN202
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(it, 2000):
                dims = b.column(0).to_numpy()
                for dim in np.unique(dims).tolist():
                    at = pa.array(np.flatnonzero(dims == dim))
                    raw, ids = b.column(1).take(at), b.column(2).take(at)
                    x = stacked(raw.to_pylist(), dim)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for t in range(tables):
                        names = axes(unit, t, probes)
                        for p in range(names.shape[1]):
                            size = len(at)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(size, dim, np.int32)), pa.array(np.full(size, t, np.int32)), pa.array(names[:, p]), pa.array(np.full(size, kind, np.int32)), raw, ids],
                                names=["dim", "tab", "bucket", "kind", "x", "ids"],
                            )

        return run

    cells = "dim int, tab int, bucket long, kind int, x binary, ids array<long>"
    unit = ["dim", "tab", "bucket", "chunk"]

    def nearest(dealt: DataFrame, sought: DataFrame) -> DataFrame:
        sizes = dealt.groupBy("dim", "tab", "bucket").agg(F.count("*").alias("n")).select("dim", "tab", "bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
        sizes = F.broadcast(sizes)  # a row a bucket: tables times twice the dimensions
        in_chunks = lambda d: d.join(sizes, ["dim", "tab", "bucket"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        both = (
            in_chunks(dealt)
            .withColumn("chunk", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int"))
            .select(*unit, "kind", "x", "ids")
            .union(in_chunks(sought).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*unit, "kind", "x", "ids"))
        )

        def rank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
                x, ids, more = stacked([r[5] for r in rows if not r[4]] or [rows[0][5]], rows[0][0]), [r[6] for r in rows if not r[4]], [r for r in rows if r[4]]
                found = []
                for lo in range(0, len(more) if ids else 0, 256):
                    some = more[lo : lo + 256]
                    z = stacked([r[5] for r in some], rows[0][0])
                    d = (x * x).sum(1)[None] + (z * z).sum(1)[:, None] - 2 * z @ x.T
                    take = min(len(ids), k + 8)
                    near = np.argpartition(d, take - 1, axis=1)[:, :take]
                    for i, at in enumerate(near):
                        own = some[i][6][0]
                        cut = d[i, at].max()
                        if take < len(ids):  # ties at the edge
                            at = np.flatnonzero(d[i] <= cut + 1e-9 * max(1.0, abs(cut)))
                        exact = np.sqrt(((x[at] - z[i]) ** 2).sum(1))
                        found += [(own, v, s) for s, v in sorted((float(s), v) for s, j in zip(exact, at.tolist(), strict=True) for v in ids[j] if v != own)[:k]]
                if found:
                    c = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64())], names=["query_id", "vec_id", "score"])

            held: list[tuple] = []
            for b in it:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (held[0][:4] != r[:4] or len(held) >= 2 * CHUNK):
                        yield from out(held)
                        # Entries come first: they stay while more queries of a unit follow.
                        held = [h for h in held if not h[4]] if held[0][:4] == r[:4] else []
                    held.append(r)
            if held:
                yield from out(held)

        return both.repartition(n_parts, *unit).sortWithinPartitions(*unit, "kind").mapInArrow(rank, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = nearest(entries.mapInArrow(deal(1, 0), cells), asked.mapInArrow(deal(probes, 1), cells))
    found = materialise(near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "ann-found")
    per = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = asked.join(per, F.col("ids")[0] == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("dim", "x", "ids")
    if short.head(1):
        whole = lambda d, kind: d.select("dim", F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("bucket"), F.lit(kind).alias("kind"), "x", "ids")
        found = found.union(nearest(whole(entries, 0), whole(short, 1))).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, among all. See ``search``."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
