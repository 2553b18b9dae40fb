"""Leakage-free splits: products that share a text stay together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.contract import text_key
from reviewspark.operators.graph import connected_components

#: Units that components are reduced to before the driver looks for a split.
BUCKETS = 4096
VERSION = "components-70-15-15"
PARTITIONS = ("train", "validation", "test")


def text_edges(reviews: DataFrame) -> DataFrame:
    """Links from each product to the least product with the same text key."""
    keyed = reviews.select("product_id", F.sha2(text_key(F.col("review_text")), 256).alias("k")).distinct()
    low = keyed.groupBy("k").agg(F.min("product_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(low, "k").where("product_id <> low").select(F.col("product_id").alias("src"), F.col("low").alias("dst")).distinct()


def product_components(reviews: DataFrame) -> DataFrame:
    """``product_id, component``: the least product that shared texts reach."""
    linked = connected_components(text_edges(reviews))
    return reviews.select("product_id").distinct().join(linked.withColumnRenamed("node", "product_id"), "product_id", "left").select("product_id", F.coalesce("component", "product_id").alias("component"))


def _reduced(reviews: DataFrame, parts: DataFrame, seed: int) -> DataFrame:
    """For each of at most ``BUCKETS`` hash buckets of components: rows (n0 to n3) and components (g0 to g3) of each class."""
    k = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(BUCKETS)).cast("int")
    per = reviews.select("product_id", "label").join(parts, "product_id").groupBy(k.alias("bucket"), "component", "label").agg(F.count("*").alias("n"))
    own = [F.col("label") == i for i in range(4)]
    return per.groupBy("bucket").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(own)], *[F.count_if(c).alias(f"g{i}") for i, c in enumerate(own)])


def search(rows: np.ndarray, groups: np.ndarray, fractions: tuple[float, ...], seed: int, tries: int = 1000, least: int = 5) -> np.ndarray | None:
    """The part (0, 1, ..) of each unit for the best of ``tries`` random orders, or None if none will do.

    ``rows`` and ``groups`` count, for each unit and class, its rows and the components that hold the
    class. An order is cut where its rows come nearest to each fraction. Orders that leave a part
    without a class, or train with fewer than ``least`` components of one, are out; of the rest the
    one counts whose parts deviate least from the fractions, in rows and in the mean over classes.
    """
    rng, total, n = np.random.default_rng(seed), rows.sum(0), rows.sum()
    if len(rows) < len(fractions) or (total == 0).any():
        return None
    best, found = np.inf, None
    for _ in range(tries):
        order = rng.permutation(len(rows))
        running = rows[order].sum(1).cumsum()
        cuts = [0]
        for i, target in enumerate(np.cumsum(fractions)[:-1] * n):
            room = np.arange(cuts[-1] + 1, len(rows) - len(fractions) + i + 2)
            cuts.append(int(room[np.abs(running[room - 1] - target).argmin()]))
        by = np.add.reduceat(rows[order], cuts, axis=0)
        if (by == 0).any() or groups[order[: cuts[1]]].sum(0).min() < least:
            continue
        off = sum(abs(b.sum() / n - f) + np.abs(b / total - f).mean() for b, f in zip(by, fractions, strict=True))
        if off < best:
            best, found = off, np.empty(len(rows), np.int64)
            found[order] = np.searchsorted(cuts, np.arange(len(rows)), side="right") - 1
    return found


def stratified_folds(rows: np.ndarray, folds: int) -> np.ndarray:
    """A fold for each unit: units of the most uneven classes first, each where the classes then spread most evenly."""
    share, fold = rows / np.maximum(rows.sum(0), 1), np.zeros(len(rows), np.int64)
    held = np.zeros((folds, rows.shape[1]))
    for u in np.argsort(-rows.std(1), kind="stable"):
        after = [np.std(held + np.where(np.arange(folds)[:, None] == f, share[u], 0), axis=0).mean() for f in range(folds)]
        fold[u] = min(range(folds), key=lambda f: (round(after[f], 12), held[f].sum()))
        held[fold[u]] += share[u]
    return fold


def assign(reviews: DataFrame, folds: int = 5, seed: int = 42, fractions: tuple[float, ...] = (0.7, 0.15, 0.15)) -> DataFrame:
    """``review_id, product_id, partition, fold``: whole components to train, validation and test, stratified folds in train.

    ``reviews`` has ``review_id, product_id, review_text, label``. Spark reduces components to at most
    ``BUCKETS`` units with counts by class, whatever the size; the search over orders works on that
    small table alone. Where no split covers all classes, or a fold's other folds lack one, this raises.
    """
    parts = product_components(reviews)
    small = _reduced(reviews, parts, seed).orderBy("bucket").toPandas()
    rows, groups = (small[[f"{k}{i}" for i in range(4)]].to_numpy(np.int64) for k in "ng")
    part = search(rows, groups, fractions, seed)
    if part is None:
        raise ValueError("no split of whole components covers all classes with five groups of each in train")
    fold = np.full(len(rows), -1)
    own = part == 0
    fold[own] = stratified_folds(rows[own], folds)
    if any((rows[own & (fold != f)].sum(0) == 0).any() or not (fold == f).any() for f in range(folds)):
        raise ValueError("a fold lacks rows, or its fitting side a class")
    table = reviews.sparkSession.createDataFrame([(int(b), PARTITIONS[p], int(f)) for b, p, f in zip(small["bucket"], part, fold, strict=True)], "bucket int, partition string, fold int")
    k = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(BUCKETS)).cast("int")
    placed = parts.select("product_id", k.alias("bucket")).join(F.broadcast(table), "bucket")  # BUCKETS rows at most
    return reviews.select("review_id", "product_id").join(placed, "product_id").select("review_id", "product_id", "partition", "fold")


def write_manifest(split: DataFrame, path: str, fingerprint: str, seed: int = 42, version: str = VERSION) -> None:
    """Records as Parquet and one JSON row with version, seed, fingerprint of the reviews and counts; a folder that exists raises."""
    records = split.select("review_id", "product_id", "partition", "fold")
    records.write.mode("errorifexists").parquet(f"{path}/records")
    counts = split.groupBy("partition").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("partition", "n")))).alias("counts"))
    counts.select(F.lit(version).alias("version"), F.lit(seed).alias("seed"), F.lit(fingerprint).alias("dataset_sha256"), "counts").write.json(f"{path}/meta")


def read_manifest(reviews: DataFrame, path: str, fingerprint: str, version: str = VERSION) -> DataFrame:
    """Reviews with ``partition`` and ``fold`` of a manifest; one of another version or table, or one that breaks a rule, raises."""
    spark = reviews.sparkSession
    meta = spark.read.schema("version string, seed int, dataset_sha256 string, counts map<string,bigint>").json(f"{path}/meta").first()
    if (meta["version"], meta["dataset_sha256"]) != (version, fingerprint):
        raise ValueError("the manifest belongs to another version or table")
    split = spark.read.schema("review_id string, product_id string, partition string, fold int").parquet(f"{path}/records")
    bad = [r["rule"] for r in violations(reviews, split).where("n > 0").collect()]
    if bad:
        raise ValueError(f"the manifest breaks: {', '.join(sorted(bad))}")
    return reviews.join(split, ["review_id", "product_id"])


def prepare(reviews: DataFrame, path: str, fingerprint: str, seed: int = 42) -> DataFrame:
    """The manifest at ``path`` if there is one, else a new split written there; joined to the reviews."""
    spark = reviews.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        write_manifest(assign(reviews, seed=seed), path, fingerprint, seed)
    return read_manifest(reviews, path, fingerprint)


def violations(reviews: DataFrame, split: DataFrame) -> DataFrame:
    """Number of breaches of each rule that a split must keep."""
    both = reviews.select("review_id", "product_id", F.sha2(text_key(F.col("review_text")), 256).alias("k")).join(split, ["review_id", "product_id"], "full")
    rules = [
        both.where("partition is null or k is null").agg(F.lit("coverage").alias("rule"), F.count("*").alias("n")),
        split.groupBy("review_id").count().where("count > 1").agg(F.lit("assigned_once").alias("rule"), F.count("*").alias("n")),
        split.where("(partition = 'train' and fold not between 0 and 4) or (partition <> 'train' and fold <> -1)").agg(F.lit("fold_range").alias("rule"), F.count("*").alias("n")),
    ]
    for key, name in (("product_id", "product"), ("k", "text")):
        for what in ("partition", "fold"):
            rows = both if what == "partition" else both.where("partition = 'train'")
            low = rows.groupBy(key).agg((F.min(what) != F.max(what)).alias("bad")).where("bad")
            rules.append(low.agg(F.lit(f"{name}_{what}").alias("rule"), F.count("*").alias("n")))
    named = reviews.sparkSession.createDataFrame([(p,) for p in PARTITIONS], "partition string")
    rules.append(named.join(split, "partition", "left_anti").agg(F.lit("empty_partition").alias("rule"), F.count("*").alias("n")))
    numbered = reviews.sparkSession.range(5).select(F.col("id").cast("int").alias("fold"))
    rules.append(numbered.join(split.where("partition = 'train'"), "fold", "left_anti").agg(F.lit("empty_fold").alias("rule"), F.count("*").alias("n")))
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out
