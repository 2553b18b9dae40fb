"""Places of rows in an order, counted over ranges of it, so that no task holds a whole group."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.operators.graph import ensure_checkpoint_dir


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: its rows and their partitions are fixed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows dealt to ranges of (by, order), ascending with nulls first: adds ``__part``, the number of the range.

    Rows that are equal in all these columns are told apart by their place in the input, so that they are cut too.
    """
    known = kept(df.withColumn("__row", F.monotonically_increasing_id()), "unordered")
    keys = [*[F.col(c).asc_nulls_first() for c in (*by, *order)], F.col("__row")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(known.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "at") -> DataFrame:
    """Adds ``name``: the place (from 0) of each row among those with equal ``by``, in ascending ``order``.

    Each range is numbered by itself and goes on from the counts of the ranges before. Equal rows take consecutive places in no stated order.
    """
    rows = ranged(df, by, order)
    counts = rows.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by_{c}") for c in by], before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order], "__row")) - 1
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__part") == F.col("__p"))
    return rows.withColumn("__own", own).join(counts, same).withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).select(*df.columns, name)
