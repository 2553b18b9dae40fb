"""A corpus pipeline of five stages: quality, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Rows with a null ``doc_id`` pass the near-duplicate stage as they are; a null text
counts as empty. Rows that repeat a kept ``doc_id`` are the same document and stay with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm import langid, packing, quality, simhash, suffix
from reviewspark.llm.common import bound_batches, forget, materialise, scratch, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits of 128 that candidates may differ in: at a Jaccard similarity of 0.8 about 19 do, and more than 38 in one pair of 10^5.
RADIUS = 38


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the weak-label quality model (fitted on ``labels``) accepts."""
    bound_batches(spark)
    scorer = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, scorer, COLUMNS).where("accepted").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which one learned language has at least half of the posterior; those without letters go."""
    bound_batches(spark)
    out = langid.predict(docs, langid.train(docs), keep=COLUMNS)
    return out.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more).

    Rows that repeat a kept row stay with it; rows of one id with other texts are judged by their own texts. An empty table gives no rows.
    """
    bound_batches(spark)
    found = simhash.near_copies(docs, words=5, radius=RADIUS, threshold=0.8)
    # A row goes by its key and its own text: other texts under the same key stay.
    gone = materialise(found.where("doc_id <> component").select("doc_id", "sha").distinct(), "copies-gone")
    gone = F.broadcast(gone) if small(gone, ["sha"]) else gone
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.select(*COLUMNS).withColumn("sha", sha).join(gone, ["doc_id", "sha"], "left_anti").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every passage of over 50 words that occurs twice, however few bytes it has."""
    bound_batches(spark)
    out = suffix.remove_passages(docs, ["doc_id", "lang", "source"], words=51)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    bound_batches(spark)
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

#: The stages learn models and compare fingerprints, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over ``documents``."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as used:
            out = stage(spark, docs, sf_dir)
        with scratch() as read_next:
            docs = materialise(out, f"pipeline-{name}")
        forget(spark, [*used, *read])  # the stage's own tables and its input
        read = read_next
    return docs
