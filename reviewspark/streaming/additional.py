"""How many reviews a scan adds to the comparable one before it, on batches and as a stream with state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Scans are comparable that agree in these.
KEY = ["url", "mode", "version"]
OUT = "url string, mode string, version string, scan timestamp, reviews long, additional long"
#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def additional_by_scan(rows: DataFrame, keep: str = "30 days") -> DataFrame:
    """``url, mode, version, scan, reviews, additional`` of each scan.

    ``rows``: url, mode, version, scan (its time) and review_id, one row for each review that was analysed; repeated
    rows count once. ``additional`` is null for a first scan and where the one before is more than ``keep`` older.
    """
    one = rows.select(*KEY, "scan", "review_id").distinct()
    scans = one.groupBy(*KEY, "scan").agg(F.count("*").alias("reviews"))
    before = F.lag("scan").over(Window.partitionBy(*KEY).orderBy("scan"))
    scans = scans.withColumn("before", F.when(F.col("scan") <= before + F.expr(f"interval {keep}"), before))
    old = one.select(*KEY, F.col("scan").alias("before"), "review_id", F.lit(True).alias("known"))
    found = one.join(scans, [*KEY, "scan"]).join(old, [*KEY, "before", "review_id"], "left").groupBy(*KEY, "scan").agg(F.count_if(F.col("known").isNull()).alias("new"))
    return scans.join(found, [*KEY, "scan"]).select(*KEY, "scan", "reviews", F.when(F.col("before").isNotNull(), F.col("new")).alias("additional"))


class Additional(StatefulProcessor):
    """Holds a key's open scans until the watermark has passed them, and the reviews of the last one that it has passed.

    A timer closes a scan; scans close in the order of their times, whatever order their rows came in.
    Another timer forgets the last scan after ``keep``.
    """

    def __init__(self, keep: str = "30 days") -> None:
        self.keep = int(pd.Timedelta(keep).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "scan long", "ids array<string>")
        self.last = handle.getValueState("last", "scan long, ids array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, set[str]] = {}
        for part in rows:
            for scan, ids in part.groupby("scan")["review_id"]:
                fresh.setdefault(int(pd.Timestamp(scan).timestamp() * 1000), set()).update(ids)
        for scan, ids in fresh.items():
            known = self.open.getValue((scan,)) if self.open.containsKey((scan,)) else None
            if known is None:
                self.handle.registerTimer(scan)
            self.open.updateValue((scan,), (sorted(ids.union(known[0] if known else ())),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        last = self.last.get() if self.last.exists() else None
        ready = sorted(k[0] for k in self.open.keys() if k[0] <= now)  # noqa: SIM118
        for scan in ready:
            ids = list(self.open.getValue((scan,))[0])
            comparable = last is not None and scan - last[0] <= self.keep
            out.append((*key, pd.Timestamp(scan, unit="ms"), len(ids), len(set(ids).difference(last[1])) if comparable else None))
            self.open.removeKey((scan,))
            last = scan, ids
        if ready:
            self.last.update((last[0], list(last[1])))
            self.handle.registerTimer(last[0] + self.keep + 1)
        elif last is not None and expiredTimerInfo.getExpiryTimeInMs() > last[0] + self.keep:
            self.last.clear()
        if out:
            table = pd.DataFrame(out, columns=[*KEY, "scan", "reviews", "additional"])
            yield table.astype({"reviews": "int64", "additional": "Int64"})

    def close(self) -> None:
        pass


def additional_stream(rows: DataFrame, late: str = "1 day", keep: str = "30 days") -> DataFrame:
    """The same as ``additional_by_scan`` for a stream: a scan comes out when the watermark, ``late`` behind the newest one, has passed it.

    Rows of scans that have come out already are late and dropped. The session needs ``PROVIDER`` as its state store.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark's own worker beside the driver doesn't see shipped packages
    timed = rows.select(*KEY, "scan", "review_id").withWatermark("scan", late)
    return timed.groupBy(*KEY).transformWithStateInPandas(Additional(keep), OUT, "append", "eventtime")
