"""Readers of review tables, drafts, requests and pages; writers of results."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions.contract import map_quality, normalize_rating, parse_annotations, parse_image_urls

REQUIRED = ("review_id", "product_id", "product_title", "review_text", "review_image_urls", "star_rating", "text_label", "ground_truth")
REQUEST = (
    "schemaVersion string, platform string, url string, productTitle string, productDescription string, productCategory string, marketplaceRating double, "
    "reviews array<struct<id:string,text:string,rating:int,hasImage:boolean,imageUrls:array<string>>>"
)


def read_reviews(spark: SparkSession, path: str, annotations: bool = False) -> DataFrame:
    """Review CSV with all values as text, empties kept and derived columns added; ``problems`` lists what is wrong with a row."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
    missing = sorted(set(REQUIRED + (("aspect_annotations",) if annotations else ())) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = raw.na.fill("")
    df = df if "product_description" in df.columns else df.withColumn("product_description", F.lit(""))
    df = df.withColumns({c: F.trim(F.col(c)) for c in ("review_id", "product_id")})
    df = df.withColumns({"label": map_quality(F.col("ground_truth")), "text_target": map_quality(F.col("text_label")), "normalized_rating": normalize_rating(F.col("star_rating")), "image_urls": parse_image_urls(F.col("review_image_urls"))})
    if annotations:
        empty = F.from_json(F.lit("[]"), "array<struct<category:string,sentiment:int,evidence:array<string>>>")
        df = df.withColumn("annotations", F.when(F.col("label") == 0, parse_annotations(F.col("aspect_annotations"))).otherwise(empty))
    twice = df.groupBy("review_id").agg((F.count("*") > 1).alias("twice"))
    rules = [("blank_id", (F.col("review_id") == "") | (F.col("product_id") == "")), ("duplicate_id", F.col("twice")), ("blank_text", F.trim("review_text") == ""), ("bad_label", F.col("label").isNull() | F.col("text_target").isNull()), ("bad_rating", F.col("normalized_rating").isNull()), ("bad_image_list", F.col("image_urls").isNull())]
    rules += [("bad_annotations", F.col("annotations").isNull())] if annotations else []
    return df.join(twice, "review_id", "left").withColumn("problems", F.array_compact(F.array(*[F.when(c, r) for r, c in rules]))).drop("twice")


def read_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Requests as JSON text, parsed, with the rules that each breaks in ``problems`` (none: valid)."""
    known = {"schemaVersion", "platform", "url", "productTitle", "productDescription", "productCategory", "marketplaceRating", "extraction", "reviews"}
    r = F.from_json(F.col(body), REQUEST)
    rev = r["reviews"]
    rules = [
        ("not_json", r.isNull() | F.json_object_keys(body).isNull()),
        ("unknown_field", F.size(F.array_except(F.json_object_keys(body), F.array(*map(F.lit, sorted(known))))) > 0),
        ("platform", ~F.coalesce(r["platform"].isin("shopee", "lazada"), F.lit(False))),
        ("review_count", ~F.coalesce(F.size(rev).between(1, 20), F.lit(False))),
        ("text_length", F.exists(rev, lambda x: ~F.coalesce(F.length(F.trim(x["text"])).between(1, 2000), F.lit(False)))),
        ("rating", F.exists(rev, lambda x: ~F.coalesce(x["rating"].between(1, 5), F.lit(False)))),
        ("image_count", F.exists(rev, lambda x: F.coalesce(F.size(x["imageUrls"]), F.lit(0)) > 5)),
        ("duplicate_id", F.size(F.array_distinct(F.transform(rev, lambda x: x["id"]))) < F.size(rev)),
    ]
    return df.withColumn("request", r).withColumn("problems", F.array_compact(F.array(*[F.when(c, n) for n, c in rules])))


class _Text(HTMLParser):
    """Paragraph texts of a page outside scripts and styles, and its title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.hidden, self.in_title = "", [""], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        self.in_title = tag == "title"
        if tag in ("p", "div", "li", "article", "br"):
            self.parts.append("")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag == "title":
            self.in_title = False
        if tag in ("p", "div", "li", "article"):
            self.parts.append("")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts[-1] += data


def html_reviews(pages: DataFrame, least: int = 20, most: int = 20) -> DataFrame:
    """Up to ``most`` distinct passages of each page that read like reviews: ``page_id, pos, title, text``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, html in zip(pdf.page_id, pdf.html, strict=True):
                p = _Text()
                p.feed(html or "")
                p.close()
                clean = [" ".join(x.split()) for x in p.parts]
                seen = {x.lower(): x for x in reversed([x for x in clean if least <= len(x) <= 2500])}
                kept = [x for x in dict.fromkeys(clean) if seen.get(x.lower()) == x][:most]
                rows += [(key, i, " ".join(p.title.split()), x) for i, x in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "title", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, title string, text string")


def write_once(df: DataFrame, path: str) -> None:
    """Write a result; a path that exists raises."""
    df.write.mode("errorifexists").parquet(path)


def write_json_once(df: DataFrame, path: str) -> None:
    """The same as JSON lines."""
    df.write.mode("errorifexists").json(path)
