"""Manifests as a graph: a case for each thing that can break."""

import pytest

from reviewspark.operators import lineage

GOOD = {"report": ("metrics", "model"), "metrics": ("cohort",), "model": ("training", "validation"), "cohort": ("dataset",), "training": ("dataset",), "validation": ("dataset",)}


def runs_of(spark, changes):
    """A run for each change of (digests, links, settings); digests are the artifacts' names unless changed."""
    artifacts, links, settings = [], [], []
    for run, (digests, extra, setting) in changes.items():
        of = {a: a for a in (*GOOD, "dataset")} | digests
        artifacts += [(run, a, d) for a, d in of.items() if d is not None]
        graph = {a: [x for x in xs if (a, x) not in extra] for a, xs in GOOD.items()}
        links += [(run, a, x, of[x] or "gone") for a, xs in graph.items() for x in xs]
        links += [(run, a, x, told) for (a, x), told in extra.items() if told is not None]
        settings += [(run, k, v) for k, v in setting.items()]
    frame = spark.createDataFrame
    return frame(artifacts, "run string, artifact string, digest string"), frame(links, "run string, artifact string, input string, input_digest string"), frame([(r, "report") for r in changes], "run string, artifact string"), frame(settings, "run string, name string, value string")


def test_every_break_is_named(spark):
    ok = {"protocol": "p1", "target": "text_label"}
    changes = {
        "base": ({}, {}, ok),
        "same": ({"report": "other", "metrics": "m2", "model": "m3"}, {}, ok),
        "data": ({"dataset": "d2", "training": "t2"}, {}, ok),
        "cohort": ({"cohort": "c2", "dataset": "d2"}, {}, ok),
        "lost": ({"validation": None}, {}, ok),
        "stale": ({}, {("model", "training"): "older"}, ok),
        "unlinked": ({}, {("model", "validation"): None}, ok),
        "protocol": ({}, {}, ok | {"protocol": "p2"}),
        "unset": ({}, {}, {"protocol": "p1"}),
        "loop": ({}, {("dataset", "cohort"): "cohort"}, ok),
    }
    artifacts, links, roots, settings = runs_of(spark, changes)
    walked = lineage.walk(artifacts, links, roots)
    depth = {r.artifact: r.depth for r in walked.where("run = 'base'").collect()}
    assert depth == {"report": 0, "metrics": 1, "model": 1, "cohort": 2, "training": 2, "validation": 2, "dataset": 3}
    assert {(r.run, r.artifact): r.problem for r in walked.where("problem is not null").collect()} == {("lost", "validation"): "missing", ("stale", "training"): "altered"}
    pairs = spark.createDataFrame([("base", x) for x in [*changes, "nobody"] if x != "base"], "a string, b string")
    got = {r.b: (r.comparable, r.node, r.reason) for r in lineage.comparable(walked, settings, pairs).collect()}
    assert got == {
        "same": (True, None, None), "data": (False, "training", "differs"), "cohort": (False, "cohort", "differs"), "lost": (False, "validation", "missing"), "stale": (False, "training", "altered"),
        "unlinked": (False, "validation", "absent"), "protocol": (False, "protocol", "setting"), "unset": (False, "target", "setting"), "loop": (True, None, None), "nobody": (False, "", "unknown"),
    }
    broken = lineage.contract_breaks(settings, roots, {"target": "text_label", "protocol": "p1"})
    assert {tuple(r) for r in broken.collect()} == {("protocol", "protocol", "p2", "p1"), ("unset", "target", None, "text_label")}


def test_manifests_that_never_end(spark):
    chain = [("r", f"n{i}", f"n{i + 1}", "d") for i in range(lineage.DEEPEST + 2)]
    artifacts = spark.createDataFrame([("r", "n0", "d")], "run string, artifact string, digest string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lineage, "DEEPEST", 3)
        with pytest.raises(ValueError, match="deep"):
            lineage.walk(artifacts, spark.createDataFrame(chain[:8], "run string, artifact string, input string, input_digest string"), artifacts.select("run", "artifact"))
