"""What the third round of findings named: queries on inputs and by figures that they failed on before."""

from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from reviewspark import catalog
from reviewspark.llm import packing, simhash, suffix
from reviewspark.operators import augment
from reviewspark.plans import batch
from reviewspark.sources.vectors import VectorCache

HEADINGS = ["Salt &amp; pepper&nbsp; mill", "cut off &amp", "cut off &am", "token = &quot;77023", "half &quo", "a &amp;quot; b &#39;c&#39; &eacute;", "&amp;nbsp;in &amp;amp; out", "fish & chips", "ends with &"]


@pytest.mark.parametrize("name", ["page_titles", "product_flags"])
def test_references_of_headings_as_in_the_sql(spark, tmp_path, name):
    """Ids 0, 4, 8, ... so that every heading is embedded as a product."""
    rows = [(4 * i, f"<html><head><title>t</title></head><body><h1>{h}</h1><p>a &amp; b</p></body></html>") for i, h in enumerate(HEADINGS)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(catalog.SQL[name].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


class Counted:
    """A tokenizer whose calls are counted."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.inner, name)


def test_words_are_encoded_together(monkeypatch):
    """Two calls of the tokenizer for a round of texts, however many mixed words they hold; a full memory changes no ids and doesn't grow."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [" ".join(f"w{i}x{i} word{'s' * (i % 3)}, n°{i}" for i in range(k, k + 50)) for k in range(0, 400, 40)]
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    own = packing.WordIds(path)
    own.tokenizer = Counted(own.tokenizer)
    ids = lambda rows: [packing.np.frombuffer(b, "<u4").tolist() for b in rows]
    assert ids(own.encode(texts)) == want and own.tokenizer.calls <= 3
    monkeypatch.setattr(packing, "CACHE", 10)
    full = packing.WordIds(path)
    assert ids(full.encode(texts)) == want == ids(full.encode(texts)) and len(full.known) <= 10


def test_hashed_words_serve_all_folds(spark):
    """Cross-fitting on words hashed once gives the chances of cross-fitting on texts, and needs no text."""
    pytest.importorskip("pyspark.ml")
    texts = ["good lid and grip", "bad lid", "fine grip, good", "no lid at all", "Good good", "bad  and worse"]
    rows = [(f"r{i}", f"p{i % 12}", "train", i % 2, i % 3, texts[i % 6] + f" n{i % 4}") for i in range(24)]
    a = spark.createDataFrame(rows, "review_id string, product_id string, partition string, fold int, label int, review_text string")
    chances = lambda d: {r.review_id: [round(x, 6) for x in r.probabilities] for r in batch.cross_fit(d, batch.text_classifier("label", 64, 3), 2).collect()}
    once = batch.hashed_words(a, 64).drop("review_text")
    assert chances(once) == chances(a) and len(chances(once)) == 24


def test_vectors_are_missed_by_keys(spark, tmp_path):
    """No content is written beside the store, equal contents are computed once, and a call adds at most a file a folder."""
    cache = VectorCache(spark, str(tmp_path / "cache"), {"encoder": "e"}, 1)
    wanted = spark.range(0, 600, 1, 8).selectExpr("concat('text ', id % 300) as content")
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(base.glob("vectors-*"))
    compute = lambda m: m.withColumn("vector", F.array(F.length("content").cast("double")))
    assert cache.prepare(wanted.where("content < 'text 2'"), compute) == {"computed": 112, "reused": 0}
    assert cache.prepare(wanted, compute) == {"computed": 188, "reused": 112}
    assert cache.prepare(wanted, compute) == {"computed": 0, "reused": 300}
    written = set(base.glob("vectors-*")) - before
    assert len(written) == 6 and all("content" not in spark.read.parquet(str(p)).columns for p in written)
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "cache" / "data").glob("*/prefix=*"))
    assert cache.get(wanted).where("problem is null and vector[0] = length(content)").count() == 600


def test_texts_reach_paraphrase_workers_in_small_batches(spark):
    """A worker gets a few MB of texts at once, whatever their number."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.unset(conf)
    try:
        out = augment.paraphrase(spark.range(3).selectExpr("cast(id as string) as review_id", "'the lid' as review_text"), {"the": ["a"]})
        assert [r.variant for r in out.collect()] == ["a lid"] * 3
        assert int(spark.conf.get(conf).removesuffix("b")) <= 4 << 20
    finally:
        spark.conf.set(conf, before)


def test_stream_of_scans_brings_repeated_events_once(spark, tmp_path, monkeypatch):
    """Forty copies of each event: the stream reads each row of a batch once, in several files, and counts as the batch form."""
    from reviewspark import queries_stores

    e = spark.range(400).selectExpr("id AS user_id", "concat('e', id % 2) AS event_type", "timestamp'2024-01-01 05:00:00' + make_interval(0, 0, 0, int(id % 9)) AS ts", "concat('r', id % 50) AS props")
    e.crossJoin(spark.range(40).select(F.lit(1))).write.parquet(f"{tmp_path}/events.parquet")
    made = []
    monkeypatch.setattr(queries_stores, "folder", lambda spark, name: made.append(f"{tmp_path}/{name}") or made[-1])
    monkeypatch.setattr(queries_stores, "FILE_ROWS", 40, raising=False)
    got, want = (sorted(map(repr, catalog.QUERIES[q](spark, str(tmp_path)).collect())) for q in ("stream_additional", "additional_by_scan"))
    assert got == want and len(got) > 20
    rows = queries_stores.scan_rows(e).distinct().count()
    brought = spark.read.parquet(f"{tmp_path}/scans-in")
    assert rows < brought.count() <= 2 * rows + 1 and len(brought.inputFiles()) > 7


def python_steps(node, above=0):
    """The most Python steps that one stage of a physical plan chains."""
    node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
    own = 0 if "Exchange" in node.nodeName() else above + any(k in node.nodeName() for k in ("InArrow", "InPandas", "EvalPython"))
    below = node.children()
    return max([own, *(python_steps(below.apply(i), own) for i in range(below.size()))])


def test_a_task_of_the_pipeline_takes_one_python_worker(spark, monkeypatch):
    """Workers stay with an executor, so that a single stage with two Python steps doubles what they hold from then on."""
    chained = {}

    def seen(df, name, f=suffix.materialise):
        chained[name] = max(chained.get(name, 0), python_steps(df._jdf.queryExecution().executedPlan()))
        return f(df, name)

    for module in (simhash, suffix, corpus_pipeline):
        monkeypatch.setattr(module, "materialise", seen)
    texts = [" ".join(f"w{(i % 3) * j}x{j}" for j in range(60)) + f" t{i}" for i in range(30)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "aa", "s", 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_duplicate_stage, corpus_pipeline.repeats_stage, corpus_pipeline.packing_stage):
        assert seen(stage(spark, docs, ""), stage.__name__).count() > 0
    assert chained.pop("suffix-blocks") == chained.pop("copies") == chained.pop("repeats_stage") == 1
    assert max(chained.values()) == 1, chained
