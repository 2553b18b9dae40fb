"""A stored cache of vectors by the digest of what they were made from."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.operators.ordering import kept
from reviewspark.sources.snapshots import Snapshots


class VectorCache:
    """Vectors under the SHA-256 of the encoder's signature and the content, in folders by the first two digits of that key.

    Another signature gives other keys, so that a cache never mixes encoders. Only folders
    of wanted keys are read. Vectors come in by ``prepare``, which computes what is missing and adds it in one step.
    """

    def __init__(self, spark: SparkSession, folder: str, signature: dict[str, object], dimension: int) -> None:
        self.signature, self.dimension = json.dumps(signature, sort_keys=True), dimension
        self.store = Snapshots(spark, folder, "content_key string, vector array<double>, prefix string", ("prefix",))

    def key(self, content: Column | str) -> Column:
        return F.sha2(F.to_json(F.struct(F.lit(self.signature).alias("signature"), (F.col(content) if isinstance(content, str) else content).alias("content"))), 256)

    def keyed(self, wanted: DataFrame, content: str) -> DataFrame:
        key = wanted.withColumn("content_key", self.key(content))
        return key.withColumn("prefix", F.concat(F.lit("k"), F.substring("content_key", 1, 2)))

    def held(self, keyed: DataFrame) -> DataFrame:
        """What the cache holds in the folders of some keys."""
        prefixes = [r[0] for r in keyed.select("prefix").distinct().collect()]  # 256 at most
        return self.store.read().where(F.col("prefix").isin(prefixes))

    def prepare(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], content: str = "content", force: bool = False) -> dict[str, int]:
        """Compute and store vectors of contents that the cache lacks (of all, with ``force``); equal contents once.

        ``compute`` takes rows ``content_key`` and ``content`` and adds ``vector``. Returns how many contents were computed and how many reused.
        What is missing is found by keys alone; only missing contents are then looked for, in a second reading of ``wanted``, which must give the same rows.
        """
        keyed = self.keyed(wanted, content).select("content_key", "prefix", F.col(content).alias("content"))
        keys = kept(keyed.select("content_key", "prefix").distinct(), "vectors-wanted")
        missing = keys if force else kept(keys.join(self.held(keys).select("content_key"), "content_key", "left_anti"), "vectors-missing")
        n, new = keys.count(), missing.count()
        if new:
            fresh = keyed if new == n else keyed.join(missing.select("content_key"), "content_key", "left_semi")
            made = compute(fresh.dropDuplicates(["content_key"]).select("content_key", "prefix", "content")).select("content_key", "vector", "prefix").repartition(256, "prefix")  # else each task writes to all folders
            rest = self.store.read().join(missing.select("content_key"), "content_key", "left_anti") if force else None
            self.store.append(made) if rest is None else self.store.replace(rest.unionByName(made))
        return {"computed": new, "reused": n - new}

    def get(self, wanted: DataFrame, content: str = "content") -> DataFrame:
        """``wanted`` with ``vector`` and ``problem``: ``missing``, ``invalid`` (another dimension, or numbers that aren't finite) or null."""
        keyed = self.keyed(wanted, content)
        v = F.col("vector")
        odd = (F.size(v) != self.dimension) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        found = keyed.join(self.held(keyed).drop("prefix"), "content_key", "left").drop("prefix")
        return found.withColumn("problem", F.when(v.isNull(), "missing").when(odd, "invalid"))

    def compact(self) -> int:
        """Put all files of a prefix together."""
        return self.store.replace(self.store.read().repartition("prefix"))
