"""Whether cohorts, predictions and records fit together before they are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.contract import ASPECTS, POLARITIES


def alignment(gold: DataFrame, filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """One row: ids that a cohort lacks, ids with another product, labels outside the four (each ``id, product_id, label``)."""
    side = lambda df, n: df.select("id", F.col("product_id").alias(f"p{n}"), F.col("label").alias(f"l{n}"))
    j = side(gold, 0).join(side(filtered, 1), "id", "full").join(side(unfiltered, 2), "id", "full")
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    bad = [F.col(f"l{n}").isNotNull() & ~F.col(f"l{n}").between(0, 3) for n in range(3)]
    return j.agg(
        is_(F.col("p1").isNull()).alias("not_in_filtered"), is_(F.col("p2").isNull()).alias("not_in_unfiltered"), is_(F.col("p0").isNull()).alias("not_in_gold"),
        is_((F.col("p0") != F.col("p1")) | (F.col("p0") != F.col("p2")) | (F.col("p1") != F.col("p2"))).alias("other_product"), is_(bad[0] | bad[1] | bad[2]).alias("bad_label"),
    )


def gate_differences(filtered: DataFrame, unfiltered: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that gating the unfiltered ones by label 0 gives and the filtered ones lack, and the other way round."""
    cols = ["review_id", "aspect", "sentiment"]
    gated = unfiltered.join(labels.where("label = 0"), "review_id", "left_semi").select(*cols)
    own = filtered.select(*cols)
    n = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias(name))
    return n(gated, own, "missing").crossJoin(n(own, gated, "extra"))


def pair_violations(pairs: DataFrame) -> DataFrame:
    """Pairs whose category (or legacy ``aspect``) or polarity, in any case, is outside the fixed lists."""
    category, mood = F.coalesce("category", "aspect"), F.lower("sentiment")
    bad = {"bad_category": ~F.coalesce(category.isin(*ASPECTS), F.lit(False)), "bad_sentiment": ~F.coalesce(mood.isin(*[p.lower() for p in POLARITIES]), F.lit(False))}
    return pairs.withColumns({k: c.cast("int") for k, c in bad.items()}).where("bad_category + bad_sentiment > 0")


def record_violations(records: DataFrame) -> DataFrame:
    """Records whose predicted categories aren't those of their pairs, or whose conditioned predictions don't cover the gold aspects exactly.

    ``records``: review_id and the arrays ``categories``, ``predicted`` (aspects of pairs), ``gold``, ``conditioned``.
    """
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    out = records.select("review_id", differ("categories", "predicted").alias("categories_differ"), differ("conditioned", "gold").alias("conditioned_differ"))
    return out.where("categories_differ or conditioned_differ")


def coverage(records: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: reviews that records miss, have without need, or give another product."""
    j = expected.select("review_id", F.col("product_id").alias("e")).join(records.select("review_id", F.col("product_id").alias("s")), "review_id", "full")
    return j.agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.coalesce(F.col("e") != F.col("s"), F.lit(False))).alias("other_product"))


def fingerprints(df: DataFrame, key: str, by: str) -> DataFrame:
    """A digest of the rows of each ``by``, whatever their order: row hashes added up in four lanes."""
    cols = sorted(c for c in df.columns if c != by)
    h = F.sha2(F.concat_ws("\u001f", F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for i in range(4)]
    return df.select(by, h.alias("h")).groupBy(by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *lanes), 256).alias("fingerprint"))
