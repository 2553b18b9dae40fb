"""A bound on the Arrow batches that Spark sends to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The setting that bounds Arrow batches, its default, and the bound that keeps two tasks of an executor small.
BATCH_CONF, DEFAULT_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2097152b"


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send workers Arrow batches of at most ``BATCH_BYTES``, unless the session has a bound of its own.

    Workers cut batches as they need them (``llm.common.sliced``), so this changes memory alone, and no result.
    """
    if spark.conf.get(BATCH_CONF) == DEFAULT_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
