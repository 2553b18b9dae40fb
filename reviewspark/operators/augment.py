"""Drafts that augment reviews: rules, lineage, union and reports of balance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.functions.contract import annotation_pairs, map_quality, text_key
from reviewspark.operators.batches import bound_batches

# The columns of a draft and their domains.
COLUMNS = ("review_id", "source_review_id", "review_text", "text_label", "ground_truth", "aspect_annotations", "image_mode", "image_source_review_id", "augmentation_method", "review_status", "reviewed_by", "review_notes")
STATUSES = ("pending", "approved", "rejected")
METHODS = ("paraphrase", "controlled_image_mismatch")
IMAGE_MODES = ("source", "donor", "none")


def check_columns(df: DataFrame) -> DataFrame:
    """Trimmed drafts; missing or further columns raise."""
    if set(df.columns) != set(COLUMNS):
        raise ValueError(f"draft columns: missing {sorted(set(COLUMNS) - set(df.columns))}, unexpected {sorted(set(df.columns) - set(COLUMNS))}")
    return df.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in COLUMNS])


def image_scopes(reviews: DataFrame) -> DataFrame:
    """``url, scopes, scope``: in how many parts and folds an address occurs, and one of them (``image_urls`` is an array)."""
    each = reviews.select(F.explode("image_urls").alias("url"), F.concat_ws("/", "partition", F.col("fold").cast("string")).alias("scope")).distinct()
    return each.groupBy("url").agg(F.count("*").alias("scopes"), F.min("scope").alias("scope"))


def shared_images(reviews: DataFrame) -> DataFrame:
    """Reviews one of whose addresses occurs in another fold or part too."""
    wide = image_scopes(reviews).where("scopes > 1")
    return reviews.select("review_id", F.explode("image_urls").alias("url")).join(wide, "url", "left_semi").select("review_id").distinct()


def draft_violations(drafts: DataFrame, reviews: DataFrame) -> DataFrame:
    """``review_id, reasons``: the rules that each draft breaks (only drafts that break one).

    ``reviews``: review_id, review_text, label, text_label, partition, fold; with ``aspect_annotations``
    evidence and pairs are judged, with ``image_urls`` the images that a draft would use.
    """
    has = set(reviews.columns)
    none = F.lit(None).cast("string")
    notes = F.col("aspect_annotations") if "aspect_annotations" in has else none
    shared = shared_images(reviews).withColumn("wide", F.lit(True)) if "image_urls" in has else None
    facts = reviews.select("review_id", "review_text", "label", "text_label", "partition", "fold", notes.alias("notes"), (F.size("image_urls") if "image_urls" in has else F.lit(1)).alias("images"))
    facts = facts.join(shared, "review_id", "left") if shared is not None else facts.withColumn("wide", F.lit(False))
    source = facts.select(F.col("review_id").alias("source_review_id"), F.lit(True).alias("s_found"), F.col("label").alias("s_label"), F.col("text_label").alias("s_text_label"), F.col("partition").alias("s_part"), F.col("fold").alias("s_fold"), F.col("review_text").alias("s_text"), F.col("notes").alias("s_notes"))
    donor = facts.select(F.col("review_id").alias("image_of"), F.lit(True).alias("d_found"), F.col("fold").alias("d_fold"), F.col("partition").alias("d_part"), F.col("images").alias("d_images"), F.coalesce("wide", F.lit(False)).alias("d_wide"))
    key = lambda c: F.sha2(text_key(F.col(c)), 256)
    known = reviews.select(key("review_text").alias("k")).distinct().withColumn("k_known", F.lit(True))
    same = reviews.select("review_id", F.lit(True).alias("taken"))
    twice = drafts.groupBy("review_id").count().where("count > 1").select("review_id", F.lit(True).alias("twice"))
    mode, method, giver = F.col("image_mode"), F.col("augmentation_method"), F.col("image_source_review_id")
    image_of = F.when(mode == "source", F.col("source_review_id")).when(mode == "donor", giver)
    j = drafts.withColumns({"image_of": image_of, "k": key("review_text")})
    j = j.join(source, "source_review_id", "left").join(donor, "image_of", "left").join(same, "review_id", "left").join(twice, "review_id", "left").join(known, "k", "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    found, d_found, mismatch = is_(F.col("s_found")), is_(F.col("d_found")), method == "controlled_image_mismatch"
    pairs, before = annotation_pairs(F.col("aspect_annotations"), F.col("review_text"), exact=True), annotation_pairs(F.col("s_notes"), F.col("s_text"))
    rules: list[tuple[str, Column]] = [
        ("blank_id", F.col("review_id") == ""),
        ("duplicate_id", is_(F.col("twice"))),
        ("id_of_original", is_(F.col("taken"))),
        ("unknown_status", ~F.col("review_status").isin(*STATUSES)),
        ("unknown_method", ~method.isin(*METHODS)),
        ("unknown_image_mode", ~mode.isin(*IMAGE_MODES)),
        ("missing_source", ~found),
        ("source_not_in_train", found & ~is_(F.col("s_part") == "train")),
        ("unsigned_approval", (F.col("review_status") == "approved") & ((F.col("reviewed_by") == "") | (F.col("review_notes") == ""))),
        ("blank_text", F.col("review_text") == ""),
        ("text_known", (F.col("review_text") != "") & is_(F.col("k_known"))),
        ("label_changed", found & ~is_(map_quality(F.col("ground_truth")) == F.col("s_label"))),
        ("text_label_changed", found & ~is_(map_quality(F.col("text_label")) == F.col("s_text_label"))),
        ("mismatch_without_donor", mismatch & (mode != "donor")),
        ("mismatch_label", mismatch & ~is_(F.col("s_label").isin(1, 3))),
        ("bad_evidence", pairs.isNull()),
        ("pairs_changed", found & is_(F.col("s_label") == 0) & F.col("s_notes").isNotNull() & pairs.isNotNull() & ~pairs.eqNullSafe(before)),
        ("donor_without_mode", (mode == "none") & (giver != "")),
        ("source_mode_with_other", (mode == "source") & (giver != "") & (giver != F.col("source_review_id"))),
        ("donor_without_mismatch", (mode == "donor") & ~mismatch),
        ("missing_donor", (mode == "donor") & ~d_found),
        ("donor_is_source", (mode == "donor") & (giver == F.col("source_review_id"))),
        ("donor_other_fold", d_found & found & ~(is_(F.col("d_fold") == F.col("s_fold")) & is_(F.col("d_part") == "train"))),
        ("no_images", d_found & is_(F.col("d_images") == 0)),
        ("image_in_other_scope", d_found & is_(F.col("d_wide"))),
    ]
    return j.select("review_id", F.array_compact(F.array(*[F.when(c, r) for r, c in rules])).alias("reasons")).where(F.size("reasons") > 0)


def usable(drafts: DataFrame, with_pending: bool = False) -> DataFrame:
    """Approved drafts, and pending ones if asked; never rejected ones."""
    return drafts.where(F.col("review_status").isin(*STATUSES[: 2 if with_pending else 0], "approved"))


def augmented(reviews: DataFrame, drafts: DataFrame, with_pending: bool = False) -> DataFrame:
    """Originals and usable drafts by name; what originals don't have is blank."""
    out = reviews.unionByName(usable(drafts, with_pending), allowMissingColumns=True)
    return out.fillna("", ["source_review_id", "augmentation_method"])


def diverse_sources(rows: DataFrame, limit: int) -> DataFrame:
    """The first sources, round robin over folds and in each over products."""
    r = F.row_number().over(Window.partitionBy("fold", "product_id").orderBy("review_id"))
    i = F.row_number().over(Window.partitionBy("fold").orderBy("r", "product_id"))
    few = rows.withColumn("r", r).where(F.col("r") <= limit)  # no product gives more than all of them
    return few.withColumn("i", i).where(F.col("i") <= limit).orderBy("i", "fold").limit(limit).select("review_id", "product_id", "fold", F.col("i").alias("turn"))


def balance(rows: DataFrame) -> DataFrame:
    """Reviews and products of each fold and class."""
    return rows.groupBy("fold", "label").agg(F.count("*").alias("reviews"), F.count_distinct("product_id").alias("products"))


def image_reuse(rows: DataFrame) -> DataFrame:
    """Addresses of images that more than one product or partition uses (``urls`` is an array)."""
    each = rows.select("product_id", "partition", F.explode("urls").alias("url"))
    return each.groupBy("url").agg(F.count_distinct("product_id").alias("products"), F.count_distinct("partition").alias("partitions")).where("products > 1 or partitions > 1")


def quality_gain(final: dict[int, int], text: dict[int, int], target: int, pair: tuple[int, int]) -> tuple[int, int]:
    """Of a (final, text) label pair: how many of its two targets lack rows, and how many rows in all."""
    lack = [max(0, target - final.get(pair[0], 0)), max(0, target - text.get(pair[1], 0))]
    return sum(x > 0 for x in lack), sum(lack)


def paraphrase(texts: DataFrame, words: dict[str, list[str]], seed: int = 42, key: str = "review_id", text: str = "review_text", evidence: str | None = None) -> DataFrame:
    """Texts with dictionary words replaced, longest first, by a choice that depends on the key alone: adds ``variant``.

    Every occurrence of a word in a text gets the same replacement. Fields between bars are put in
    another order, the last (the narrative) stays last; not where there are fewer than three fields or
    a piece of evidence crosses them. With ``evidence`` (an array of text) its pieces are replaced in
    the same way and come back as ``variant_evidence``; where one is no longer part of the text, both are null.
    """
    bound_batches(texts.sparkSession)  # a worker holds a batch of texts several times over
    names = sorted(words, key=lambda w: (-len(w), w))

    @F.pandas_udf("variant string, variant_evidence array<string>")
    def variant(k: pd.Series, t: pd.Series, e: pd.Series) -> pd.DataFrame:
        import random
        import re
        import zlib

        pattern = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in names) or r"(?!)", re.I)

        def one(key: str, s: str | None, pieces: list[str]) -> tuple[str | None, list[str] | None]:
            if s is None:
                return None, None
            pick = lambda m: words[m[0].lower()][zlib.crc32(f"{seed}:{key}:{m[0].lower()}".encode()) % len(words[m[0].lower()])]
            out, moved = pattern.sub(pick, s), [pattern.sub(pick, p) for p in pieces]
            fields = re.split(r"\s*\|\s*", out)
            if len(fields) > 2 and all(any(p in f for f in fields) for p in moved):
                order = fields[:-1]
                random.Random(zlib.crc32(f"{seed}:{key}".encode())).shuffle(order)
                out = " | ".join([*order, fields[-1]])
            return (out, moved) if all(p in out for p in moved) else (None, None)

        made = [one(a, b, [] if c is None else list(c)) for a, b, c in zip(k, t, e, strict=True)]
        return pd.DataFrame({"variant": pd.Series([m[0] for m in made], dtype=object), "variant_evidence": pd.Series([m[1] for m in made], dtype=object)})

    pieces = F.col(evidence) if evidence else F.array().cast("array<string>")
    out = texts.withColumn("__v", variant(F.col(key).cast("string"), F.col(text), pieces))
    return out.select(*texts.columns, "__v.variant", *(["__v.variant_evidence"] if evidence else []))
