"""Snapshots, the vector cache, ordered digests, and the streams with state: what breaks off, comes twice, late or in another order."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from reviewspark.operators import digest
from reviewspark.sources.snapshots import Conflict, Snapshots
from reviewspark.sources.vectors import VectorCache
from reviewspark.streaming import additional, scans


def values(df):
    return sorted(map(tuple, df.collect()))


def test_snapshots_change_in_one_step(spark, tmp_path, monkeypatch):
    s = Snapshots(spark, str(tmp_path / "s"), "k string, v long")
    assert s.read().collect() == [] and s.versions() == []
    s.append(spark.createDataFrame([("a", 1)], s.schema))
    s.append(spark.createDataFrame([("b", 2)], s.schema), ("job", 4))
    assert s.append(spark.createDataFrame([("b", 2)], s.schema), ("job", 4)) == 2 == s.append(spark.createDataFrame([("x", 2)], s.schema), ("job", 3))
    assert values(s.read()) == [("a", 1), ("b", 2)] and values(s.read(1)) == [("a", 1)]
    with monkeypatch.context() as m:  # files are written, the manifest isn't
        m.setattr(s, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            s.append(spark.createDataFrame([("c", 3)], s.schema))
    assert values(Snapshots(spark, str(tmp_path / "s"), "k string, v long").read()) == [("a", 1), ("b", 2)]
    stale = s.manifest()
    s.replace(spark.createDataFrame([("z", 9)], s.schema))
    with pytest.raises(Conflict):  # another writer was first
        s._commit(stale, stale["folders"], None)
    assert values(s.read()) == [("z", 9)] and s.versions() == [1, 2, 3]


def test_vector_cache(spark, tmp_path, monkeypatch):
    asked = []

    def compute(m):
        asked.append(sorted(r["content"] for r in m.collect()))
        return m.withColumn("vector", F.array(F.length("content").cast("double"), F.when(F.col("content") == "odd", F.lit(float("nan"))).otherwise(0.0)))

    wanted = lambda *xs: spark.createDataFrame([(x,) for x in xs], "content string")
    cache = VectorCache(spark, str(tmp_path / "v"), {"model": "m", "revision": 1}, 2)
    assert cache.prepare(wanted("a", "bb", "a"), compute) == {"computed": 2, "reused": 0}
    assert cache.prepare(wanted("a", "bb"), compute) == {"computed": 0, "reused": 2} and asked == [["a", "bb"]]
    with monkeypatch.context() as m:
        m.setattr(cache.store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            cache.prepare(wanted("ccc"), compute)
    assert [(r["content"], r["problem"]) for r in cache.get(wanted("a", "ccc")).orderBy("content").collect()] == [("a", None), ("ccc", "missing")]
    assert cache.prepare(wanted("a", "ccc", "odd"), compute) == {"computed": 2, "reused": 1}
    assert [(r["content"], r["problem"], r["vector"][0]) for r in cache.get(wanted("bb", "odd")).orderBy("content").collect()] == [("bb", None, 2.0), ("odd", "invalid", 3.0)]
    assert cache.prepare(wanted("bb"), compute, force=True) == {"computed": 1, "reused": 0}
    assert cache.store.read().count() == 4 and cache.compact() == 4 and cache.store.read().count() == 4
    other = VectorCache(spark, str(tmp_path / "v"), {"model": "m", "revision": 2}, 2)
    assert other.prepare(wanted("a"), compute) == {"computed": 1, "reused": 0}
    plan = cache.held(cache.keyed(wanted("a"), "content"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_latest_sink_drops_stale_runs_and_repeats(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "r"), "k string, run long, v string")
    write = scans.latest_sink(store, "k", "run")
    batch = lambda *rows: spark.createDataFrame(rows, store.schema)
    now = lambda: values(scans.latest(store.read(), "k", "run").select("k", "run", "v"))
    write(batch(("a", 3, "x"), ("a", 5, "y"), ("b", 1, "z")), 0)
    assert now() == [("a", 5, "y"), ("b", 1, "z")]
    write(batch(("a", 4, "late"), ("b", 2, "new"), ("a", 5, "again")), 1)
    assert now() == [("a", 5, "y"), ("b", 2, "new")]
    version = store.versions()
    write(batch(("a", 9, "replayed")), 1)
    assert now() == [("a", 5, "y"), ("b", 2, "new")] and store.versions() == version
    write(batch(("a", 9, "next")), 2)
    assert now()[0] == ("a", 9, "next")


def test_additional_reviews_as_a_stream(spark, tmp_path):
    """Rows come out of order and twice, and the stream starts again from its checkpoint in between."""
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [("u", "m", "1", day(n), f"r{i}") for n in (1, 2, 3, 9) for i in range(n, n + 4)] + [("u", "other", "1", day(2), "r1"), ("w", "m", "1", day(4), "r1"), ("w", "m", "2", day(5), "r1")]
    files = [rows[4:9], [*rows[:5], rows[-3]], [*rows[9:12], rows[0], rows[-2], rows[-1]], rows[12:]]
    schema, spark_conf = "url string, mode string, version string, scan timestamp, review_id string", "spark.sql.streaming.stateStore.providerClass"
    at, out, done = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    before = spark.conf.get(spark_conf)
    spark.conf.set(spark_conf, additional.PROVIDER)
    try:
        for f in [*files, [("", "", "", day(28), "")]]:
            spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(at)
            stream = spark.readStream.schema(schema).parquet(at)
            got = additional.additional_stream(stream, "8 days", "5 days")
            got.writeStream.format("parquet").option("path", out).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(spark_conf, before)
    found = spark.read.parquet(out).where("url <> ''")
    want = additional.additional_by_scan(spark.createDataFrame(rows, schema), "5 days")
    order = lambda df: sorted(map(repr, df.select(*additional.KEY, "scan", "reviews", "additional").collect()))
    assert order(found) == order(want)
    assert [r["additional"] for r in want.where("url = 'u' and mode = 'm'").orderBy("scan").collect()] == [None, 1, 1, None]


def test_ordered_digest(spark):
    rows = [(f"r{i:03}", i % 7, None if i % 5 else "x") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, v int, w string")
    told = lambda d, **k: tuple(digest.ordered_digest(d, ["id"], leaf=16, **k).first())
    one = told(df)
    assert one == told(df.repartition(9)) == told(df.orderBy(F.desc("id")).select("w", "id", "v")) and one[1] == 200
    swapped = [*rows]
    swapped[3], swapped[4] = (rows[3][0], *rows[4][1:]), (rows[4][0], *rows[3][1:])
    assert told(spark.createDataFrame(swapped, df.schema)) != one
    renamed = [(f"r{(i + 1) % 200:03}", *r[1:]) for i, r in enumerate(rows)]  # the same values in another order
    assert told(spark.createDataFrame(renamed, df.schema), columns=["v", "w"]) != told(df, columns=["v", "w"])
    assert told(df.limit(0)) == (hashlib.sha256(b"").hexdigest(), 0)
    own = df.select(digest.row_digest(df.columns)).first()[0]
    v, w = '{"v":0}', '{"v":"x"}'
    assert own == hashlib.sha256(f'id=12:{{"v":"r000"}};v={len(v)}:{v};w={len(w)}:{w};'.encode()).hexdigest()
