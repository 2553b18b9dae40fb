"""A digest of ordered rows as a tree of hashes, so that order counts and no task holds the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.operators.ordering import numbered

#: Rows, or nodes, that are hashed together.
LEAF = 1000


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: names and values of its columns by name, each with its length, ``-`` for null; other than text as JSON."""
    parts = []
    for c in sorted(columns):
        s = F.to_json(F.struct(F.col(c).alias("v")))
        parts.append(F.concat(F.lit(f"{c}="), F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)), F.lit(";")))
    return F.sha2(F.concat(*parts), 256)


def ordered_digest(df: DataFrame, order: list[str], columns: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """One row: ``digest`` and ``rows`` of the columns (all, if none are given) in ascending ``order``, nulls first.

    Rows are numbered over ranges; each run of ``leaf`` row digests is hashed, then each run of these, until one is left. So the digest
    depends on the rows and their order alone, not on how they are stored. Rows with equal ``order`` stand by their digests. No rows give the digest of nothing.
    """
    rows = numbered(df.select(*order, row_digest(columns or df.columns).alias("digest")), [], [*order, "digest"]).select("at", "digest")
    n = left = rows.count()
    while True:
        runs = F.array_sort(F.collect_list(F.struct("at", "digest")))
        whole = F.array_join(F.transform(runs, lambda x: x["digest"]), "")
        if left <= leaf:
            return rows.agg(F.sha2(whole, 256).alias("digest"), F.lit(n).cast("long").alias("rows"))
        rows = rows.groupBy(F.floor(F.col("at") / leaf).alias("run")).agg(F.sha2(whole, 256).alias("digest")).withColumnRenamed("run", "at")
        left = -(-left // leaf)
