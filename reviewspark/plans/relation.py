"""The test relation: documents seen as reviews, with predictions and aspect pairs made from their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions.text import Lexicon

#: Frequent words of the invented corpus; the real lexicon hits nothing there.
WORDS = Lexicon(positive=("the", "and", "with", "de"), negative=("was", "that", "from", "en"), delivery=("this", "les", "ing"), product=("by", "ly", "or"), delivery_tokens=400)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, review_id, product_id, review_text, star_rating, label, truth, pred``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    n = max(40, docs.count() // 5)
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).when(F.col("quality") == 1, 1).when(F.col("toxic") == 0, 2).when(F.col("quality") == 0, 3)
    truth = F.coalesce("label", (F.col("doc_id") % 4).cast("int"))
    return (
        docs.join(labels, "doc_id", "left")
        .select(
            "doc_id",
            F.concat(F.lit("review_"), F.col("doc_id").cast("string")).alias("review_id"),
            F.concat(F.lit("p"), (F.col("doc_id") % n).cast("string")).alias("product_id"),
            F.col("text").alias("review_text"),
            (1 + (F.col("doc_id") * 7) % 5).cast("int").alias("star_rating"),
            label.cast("int").alias("label"),
        )
        .withColumn("truth", truth)
        .withColumn("pred", F.when(F.col("doc_id") % 5 == 0, (F.col("truth") + 1) % 4).otherwise(F.col("truth")).cast("int"))
    )


def gold_pairs(rows: DataFrame) -> DataFrame:
    """``review_id, aspect, sentiment``: one or two aspects of each review."""
    a = F.explode(F.array_distinct(F.array((F.col("doc_id") % 10).cast("int"), ((F.col("doc_id") * 3 + 1) % 10).cast("int"))))
    return rows.select("review_id", "doc_id", a.alias("aspect")).select("review_id", "aspect", ((F.col("doc_id") + F.col("aspect")) % 3).cast("int").alias("sentiment"))


def predicted_pairs(rows: DataFrame) -> DataFrame:
    """The same with every seventh review's second aspect missed and every sixth's polarity off by one."""
    second = F.when(F.col("doc_id") % 7 != 0, ((F.col("doc_id") * 3 + 1) % 10).cast("int"))
    a = F.explode(F.array_distinct(F.array_compact(F.array((F.col("doc_id") % 10).cast("int"), second))))
    return rows.select("review_id", "doc_id", a.alias("aspect")).select("review_id", "aspect", ((F.col("doc_id") + F.col("aspect") + (F.col("doc_id") % 6 == 0).cast("int")) % 3).cast("int").alias("sentiment"))


def families(rows: DataFrame) -> DataFrame:
    """``id, label, family``: every third review counts as a draft of the one before."""
    return rows.select("doc_id", F.col("doc_id").alias("id"), (F.floor(F.col("doc_id") / 3) * 3).cast("long").alias("family")).select("id", "family", (F.col("family") % 4).cast("int").alias("label"))


def assigned(rows: DataFrame) -> DataFrame:
    """Reviews with a stated ``partition`` and ``fold``: by product number, so that shared texts leak."""
    pn = F.substring("product_id", 2, 20).try_cast("bigint") % 20  # null for a product of another kind
    name = F.when(pn < 14, "train").when(pn < 17, "validation").otherwise("test")
    return rows.withColumn("partition", name).withColumn("fold", F.when(pn < 14, pn % 5).otherwise(-1).cast("int"))


def broken_split(rows: DataFrame) -> DataFrame:
    """The stated split with some reviews left out, some stated twice and some moved to test."""
    a, d = assigned(rows), F.col("doc_id")
    moved = F.when(d % 101 == 0, "test").otherwise(F.col("partition"))
    first = a.where(d % 97 != 0).select("review_id", "product_id", moved.alias("partition"), "fold")
    return first.union(a.where(d % 89 == 0).select("review_id", "product_id", "partition", "fold"))


def chances(d: Column | str = "doc_id") -> Column:
    """Chances of four classes: tenths by the id."""
    d = F.col(d) if isinstance(d, str) else d
    return F.array(*[((d * 3 + i) % 4 + 1) / 10.0 for i in range(4)])


def out_of_fold(rows: DataFrame) -> DataFrame:
    """Out-of-fold predictions of training reviews, some of which break rules."""
    a, d = assigned(rows).where("partition = 'train'"), F.col("doc_id")
    fold = F.when(d % 59 == 0, (F.col("fold") + 1) % 5).otherwise(F.col("fold"))
    source = F.when(d % 61 == 0, "final_text_model").otherwise(F.concat(F.lit("oof_fold_"), fold.cast("string")))
    p = F.when(d % 67 == 0, F.array(F.lit(0.9), F.lit(0.9), F.lit(0.0), F.lit(0.0))).otherwise(chances())
    one = a.where(d % 53 != 0).select("review_id", F.when(d % 71 == 0, "elsewhere").otherwise(F.col("product_id")).alias("product_id"), fold.cast("int").alias("fold"), source.alias("probability_source"), p.alias("probabilities"))
    return one.union(a.where(d % 73 == 0).select("review_id", "product_id", "fold", F.concat(F.lit("oof_fold_"), F.col("fold").cast("string")), chances()))


#: The same relation for DuckDB.
SQL = """
WITH num AS (SELECT greatest(40, count(*) // 5) AS n FROM documents),
base AS (
  SELECT d.doc_id, 'review_' || d.doc_id AS review_id, 'p' || (d.doc_id % num.n) AS product_id, d.text AS review_text,
         (1 + (d.doc_id * 7) % 5)::INT AS star_rating,
         (CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 WHEN toxic = 0 THEN 2 WHEN quality = 0 THEN 3 END)::INT AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, num),
truths AS (SELECT *, coalesce(label, doc_id % 4)::INT AS truth FROM base),
reviews AS (SELECT *, (CASE WHEN doc_id % 5 = 0 THEN (truth + 1) % 4 ELSE truth END)::INT AS pred FROM truths),
gold AS (
  SELECT DISTINCT review_id, a::INT AS aspect, ((doc_id + a) % 3)::INT AS sentiment
  FROM (SELECT review_id, doc_id, doc_id % 10 AS a FROM reviews UNION ALL SELECT review_id, doc_id, (doc_id * 3 + 1) % 10 FROM reviews)),
predicted AS (
  SELECT DISTINCT review_id, a::INT AS aspect, ((doc_id + a + (doc_id % 6 = 0)::INT) % 3)::INT AS sentiment
  FROM (SELECT review_id, doc_id, doc_id % 10 AS a FROM reviews UNION ALL SELECT review_id, doc_id, (doc_id * 3 + 1) % 10 FROM reviews WHERE doc_id % 7 <> 0)),
fam AS (SELECT doc_id AS id, (doc_id // 3) * 3 AS family, (((doc_id // 3) * 3) % 4)::INT AS label FROM documents),
aspects AS (SELECT unnest(range(10))::INT AS aspect),
four AS (SELECT unnest(range(4))::INT AS label),
assigned AS (SELECT *, CASE WHEN pn < 14 THEN 'train' WHEN pn < 17 THEN 'validation' ELSE 'test' END AS part, (CASE WHEN pn < 14 THEN pn % 5 ELSE -1 END)::INT AS fold FROM (SELECT *, substr(product_id, 2)::BIGINT % 20 AS pn FROM reviews)),
split AS (SELECT review_id, product_id, CASE WHEN doc_id % 101 = 0 THEN 'test' ELSE part END AS part, fold FROM assigned WHERE doc_id % 97 <> 0 UNION ALL SELECT review_id, product_id, part, fold FROM assigned WHERE doc_id % 89 = 0),
oof AS (SELECT review_id, CASE WHEN doc_id % 71 = 0 THEN 'elsewhere' ELSE product_id END AS product_id, f AS fold, CASE WHEN doc_id % 61 = 0 THEN 'final_text_model' ELSE 'oof_fold_' || f END AS source, doc_id % 67 = 0 AS bad,
    CASE WHEN doc_id % 67 = 0 THEN [0.9, 0.9, 0.0, 0.0] ELSE [((doc_id * 3) % 4 + 1) / 10.0, ((doc_id * 3 + 1) % 4 + 1) / 10.0, ((doc_id * 3 + 2) % 4 + 1) / 10.0, ((doc_id * 3 + 3) % 4 + 1) / 10.0] END AS p
  FROM (SELECT *, (CASE WHEN doc_id % 59 = 0 THEN (fold + 1) % 5 ELSE fold END)::INT AS f FROM assigned WHERE part = 'train') WHERE doc_id % 53 <> 0
  UNION ALL SELECT review_id, product_id, fold, 'oof_fold_' || fold, false, [((doc_id * 3) % 4 + 1) / 10.0, ((doc_id * 3 + 1) % 4 + 1) / 10.0, ((doc_id * 3 + 2) % 4 + 1) / 10.0, ((doc_id * 3 + 3) % 4 + 1) / 10.0] FROM assigned WHERE part = 'train' AND doc_id % 73 = 0)
"""
