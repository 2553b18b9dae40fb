"""Page-session behaviour as streams over timed events (our extension): quiet periods and changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.sources.snapshots import Snapshots


def quiet_periods(events: DataFrame, gap: str = "2200 milliseconds", late: str = "1 minute", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """One row for each burst of events of a key that a pause ends; works on batches and streams."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(scans: DataFrame, key: str = "key", signature: str = "signature") -> DataFrame:
    """Scans whose signature is new for their key."""
    return scans.dropDuplicates([key, signature])


def latest(runs: DataFrame, key: str, run: str) -> DataFrame:
    """The row of each key with the greatest run: whatever earlier runs bring later is stale. ``latest_sink`` does the same for a stream."""
    last = runs.groupBy(key).agg(F.max(F.struct(run, *[c for c in runs.columns if c not in (key, run)])).alias("last"))
    return last.select(key, "last.*")


def latest_sink(store: Snapshots, key: str, run: str, source: str = "runs") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds to the store what is newer than the last run of its key; stale rows are dropped.

    Rows and batch number are put down in one step, so that a batch that comes again changes nothing.
    ``latest(store.read(), key, run)`` is the table at any time. A run that is known already counts as stale.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = latest(batch.select(store.schema.fieldNames()), key, run)
        known = store.read().groupBy(F.col(key).alias("__key")).agg(F.max(run).alias("__run"))
        newer = fresh.join(known, F.col(key) == F.col("__key"), "left").where(F.col("__run").isNull() | (F.col(run) > F.col("__run")))
        store.append(newer.select(store.schema.fieldNames()), (source, number))

    return write
