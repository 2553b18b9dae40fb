"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.operators.batches import BATCH_BYTES, BATCH_CONF, DEFAULT_BYTES, bound_batches  # noqa: F401
from reviewspark.operators.graph import ensure_checkpoint_dir

#: Rows of whole texts that a worker turns into Python objects at once.
ARROW_ROWS = 500
#: Bytes of a table that may be sent to all tasks.
SMALL = 32 << 20
#: Steps that a range of keys is cut into at once.
CELLS = 4096
#: The characters that end a word in the contracts: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MULT = np.uint64(6364136223846793005)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, columns: list[str], limit: int = SMALL) -> bool:
    """Whether a written table may be sent to all tasks: its text and binary ``columns`` and 64 bytes a row are at most ``limit``."""
    held = F.count("*") * 64 + sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns), F.lit(0))
    return df.agg(held.alias("n")).first()["n"] <= limit


#: Folders written since ``scratch`` was entered, innermost last.
_written: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage ends and rows are fixed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Names the folders that ``materialise`` writes meanwhile, for ``forget`` once nothing reads them any more."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        _written.pop()


def forget(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of intermediate tables."""
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(it: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for b in it:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def range_cuts(df: DataFrame, key: str, parts: int, weight: Column | None = None) -> list[int]:
    """Ascending keys that cut an integer column into ranges of about equal weight (rows, if none is given).

    Exact weights of ``CELLS`` or more equal steps of the key come to the driver; steps that hold more than a
    range's weight are cut again. The cuts depend on the rows alone, not on how they are stored; a key
    that holds more than a range by itself is not cut.
    """
    cells = max(CELLS, 8 * parts)
    rows = df.select(F.col(key).cast("long").alias("k"), (F.lit(1) if weight is None else weight).cast("long").alias("w")).where("k is not null")
    low, high, total = rows.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if parts < 2 or low is None:
        return []
    share = max(1, total // parts)

    def weights(a: int, b: int) -> list[tuple[int, int, int]]:
        step = -(-(b - a + 1) // cells)
        cell = F.expr(f"(cast(k as decimal(20, 0)) - cast('{a}' as decimal(20, 0))) div cast('{step}' as decimal(20, 0))")
        found = rows.where(F.col("k").between(a, b)).groupBy(cell.alias("c")).agg(F.sum("w").alias("w")).orderBy("c").collect()
        out = []
        for r in found:
            lo = a + r["c"] * step
            hi = min(b, lo + step - 1)
            out += weights(lo, hi) if r["w"] > share and hi > lo else [(lo, hi, r["w"])]
        return out

    cuts, held = [], 0
    for lo, _, w in weights(low, high):
        if held and held + w > share:
            cuts.append(lo)
            held = 0
        held += w
    return cuts


def range_of(key: str, cuts: list[int]) -> Column:
    """Number of the range that a key falls in (null: the first), looked up in Arrow batches."""
    at = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def look(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, k.to_numpy(np.int64), side="right").astype(np.int32))

    least = F.lit(-(2**63))
    return look(F.coalesce(F.col(key).cast("long"), least)) if cuts else F.lit(0)


def text_bytes(s: str | None) -> bytes:
    """UTF-8 of a text; a null is empty."""
    return s.encode("utf-8", "surrogatepass") if s else b""


def table_of_bytes(seed: int) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (two xor-shift-multiply steps)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


#: Powers that a worker keeps.
POWERS_KEPT = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64.

    Shorter arrays use the table of a longer one; one for more than ``POWERS_KEPT`` goes when a shorter one is asked for.
    """
    size, held = 1 << max(12, (n - 1).bit_length()), next(iter(_POWERS), 0)
    if size > held or held > max(size, POWERS_KEPT):
        up = np.full(size, MULT)
        down = np.full(size, np.uint64(pow(int(MULT), -1, 2**64)))
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = next(iter(_POWERS.values()))
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers data[:i]; see ``span_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hash of data[start:end], equal for equal bytes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are no white space."""
    is_word = np.ones(256, np.int8)
    is_word[list(SPACES)] = 0
    edge = np.diff(is_word[data], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Hash of each data[start:end], for ascending starts of words that don't overlap."""
    out = np.zeros(len(start), np.uint64)
    for lo in range(0, len(data), step):
        a, b = np.searchsorted(start, [lo, lo + step])
        if a < b:
            part = data[lo : end[b - 1]]
            out[a:b] = mix(span_hash(prefix_hash(part, values), start[a:b] - lo, end[a:b] - lo))
    return out
