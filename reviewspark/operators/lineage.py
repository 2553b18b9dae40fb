"""Where results come from, as a graph of manifests linked by digests, and whether two results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.operators.ordering import kept

#: What two results must share to be compared, unless stated otherwise.
SHARED = ("dataset", "training", "validation", "cohort")
DEEPEST = 50


def walk(artifacts: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Every artifact that a run's roots rest on: ``run, artifact, depth, digest, problem``.

    ``artifacts``: run, artifact, digest (its manifest); ``links``: run, artifact, input, input_digest (what its manifest
    says of an input); ``roots``: run, artifact. ``depth`` is the least number of links from a root. ``problem``: ``missing`` (no manifest), ``altered`` (a link
    from within the walk states another digest than the manifest does), or null. A manifest that rests on itself is walked once.
    """
    seen = kept(roots.select("run", "artifact", F.lit(0).alias("depth")).distinct(), "lineage")
    front = seen
    for depth in range(1, DEEPEST + 1):
        new = links.join(front.select("run", "artifact"), ["run", "artifact"], "left_semi").select("run", F.col("input").alias("artifact")).distinct()
        front = kept(new.join(seen, ["run", "artifact"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    else:
        raise ValueError(f"manifests are linked more than {DEEPEST} deep")
    told = links.join(seen.select("run", "artifact"), ["run", "artifact"], "left_semi").groupBy("run", F.col("input").alias("artifact")).agg(F.collect_set("input_digest").alias("told"))
    found = seen.join(artifacts.select("run", "artifact", "digest"), ["run", "artifact"], "left").join(told, ["run", "artifact"], "left")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.exists("told", lambda t: t != F.col("digest")), "altered")
    return found.select("run", "artifact", "depth", "digest", problem.alias("problem"))


def comparable(walked: DataFrame, settings: DataFrame, pairs: DataFrame, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """``a, b, comparable, node, reason``: whether two runs can be compared, and the first node that speaks against it.

    ``settings``: run, name, value; ``pairs``: a, b. Reasons, the nearest to the roots first, then by node: ``missing`` or ``altered`` in either
    run, ``absent`` (one run doesn't rest on a shared artifact), ``differs`` (its digests differ), and at the end ``setting`` (the node is its name).
    A pair of which a run rests on nothing has the reason ``unknown``.
    """
    side = lambda c: pairs.join(walked, F.col(c) == F.col("run")).select("a", "b", "artifact", *[F.col(x).alias(f"{x}_{c}") for x in ("depth", "digest", "problem")])
    both = side("a").join(side("b"), ["a", "b", "artifact"], "full")
    must = F.col("artifact").isin(list(shared))
    reason = (
        F.coalesce("problem_a", "problem_b", F.when(must & (F.col("depth_a").isNull() | F.col("depth_b").isNull()), "absent"))
    )
    reason = F.coalesce(reason, F.when(must & (F.col("digest_a") != F.col("digest_b")), "differs"))
    nodes = both.select("a", "b", F.coalesce(F.least("depth_a", "depth_b"), "depth_a", "depth_b").alias("depth"), F.col("artifact").alias("node"), reason.alias("reason"))
    own = lambda c: pairs.join(settings, F.col(c) == F.col("run")).select("a", "b", "name", F.col("value").alias(f"value_{c}"))
    off = own("a").join(own("b"), ["a", "b", "name"], "full").where(~F.col("value_a").eqNullSafe(F.col("value_b")))
    known = walked.select("run").distinct()
    lost = pairs.join(known.select(F.col("run").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(known.select(F.col("run").alias("b"), F.lit(True).alias("has_b")), "b", "left").where("has_a is null or has_b is null")
    found = (
        nodes.where("reason is not null")
        .unionByName(off.select("a", "b", F.lit(DEEPEST + 1).alias("depth"), F.col("name").alias("node"), F.lit("setting").alias("reason")))
        .unionByName(lost.select("a", "b", F.lit(-1).alias("depth"), F.lit("").alias("node"), F.lit("unknown").alias("reason")))
    )
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("depth", "node", "reason"))).where("r = 1")
    return pairs.join(first, ["a", "b"], "left").select("a", "b", F.col("reason").isNull().alias("comparable"), "node", "reason")


def contract_breaks(settings: DataFrame, runs: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``run, name, value, expected`` of settings that a run must have as stated (input version, target column and the like) and doesn't."""
    want = settings.sparkSession.createDataFrame(list(expected.items()), "name string, expected string")
    all_ = runs.select("run").distinct().crossJoin(F.broadcast(want))  # a few rows a run
    return all_.join(settings, ["run", "name"], "left").where(~F.col("value").eqNullSafe(F.col("expected"))).select("run", "name", "value", "expected")
