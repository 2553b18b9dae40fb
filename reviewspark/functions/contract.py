"""Values with a fixed meaning, and expressions that check and normalise columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
CLASSES = ("authentic", "deceptive", "liv", "irrelevant")
LABEL_ALIASES = ("vague", "low informational value", "low_informational_value", "low-value", "low_value")
POLARITIES = ("Negative", "Neutral", "Positive")
ASPECTS = (
    "product_quality",
    "functionality",
    "performance",
    "design",
    "aesthetics",
    "sensory_experience",
    "value",
    "packaging",
    "seller_service",
    "accuracy_of_description",
)
DEFINITIONS = {
    "product_quality": "Overall build, material quality, durability, or craftsmanship.",
    "functionality": "Whether the product has the expected features or capabilities.",
    "performance": "How well functions work: speed, responsiveness, lag, accuracy, sound, battery performance, results, effectiveness, or reliability.",
    "design": "Ergonomics, form, layout, fit, comfort, feel in the hand, non-beauty texture, or ease of use.",
    "aesthetics": "Purely visual appeal: color, appearance, style, or look.",
    "sensory_experience": "Beauty, skincare, and personal care only: smell, fragrance, texture, consistency, or feel on the skin.",
    "value": "Worth its price: sulit, affordable, expensive, or overpriced.",
    "packaging": "Box condition, wrapping, protection, presentation, or secure packing.",
    "seller_service": "Concrete seller responsiveness, communication, assistance, support, or problem resolution; exclude general thanks or praise.",
    "accuracy_of_description": "Reviewer-stated agreement or mismatch with advertised size, color, variation, specifications, or features.",
}
CONTEXT_TOKENS, TITLE_TOKENS = 28, 10

ANNOTATIONS = "array<struct<category:string,text:string,sentiment:string>>"


def aspects(spark: SparkSession) -> DataFrame:
    """Dimension ``aspect, category``: ten rows, in the order of reports."""
    return spark.createDataFrame(list(enumerate(ASPECTS)), "aspect int, category string").hint("broadcast")


def classes(spark: SparkSession) -> DataFrame:
    """Dimension ``label, class``: four rows."""
    return spark.createDataFrame(list(enumerate(CLASSES)), "label int, class string").hint("broadcast")


def _number(c: Column, top: int) -> Column:
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x) & (x == F.floor(x)) & x.between(0, top), x.cast("int"))


def map_quality(c: Column) -> Column:
    """Label 0 to 3 of a class name, alias or whole number; null where it is none of them."""
    name = F.lower(F.trim(c))
    out = F.when(name.isin(*LABEL_ALIASES), F.lit(2))
    for i, k in enumerate(CLASSES):
        out = out.when(name == k, F.lit(i))
    return out.otherwise(_number(c, 3))


def map_polarity(c: Column) -> Column:
    """0 Negative, 1 Neutral, 2 Positive, by name in any case or number; null otherwise."""
    name, out = F.lower(F.trim(c)), F.when(F.lit(False), F.lit(0))
    for i, k in enumerate(POLARITIES):
        out = out.when(name == k.lower(), F.lit(i))
    return out.otherwise(_number(c, 2))


def normalize_rating(c: Column) -> Column:
    """(r - 1) / 4 of a whole rating 1 to 5; null otherwise."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (x == F.floor(x)) & x.between(1, 5), (x - 1) / 4)


def parse_image_urls(c: Column) -> Column:
    """Distinct trimmed addresses in their order, from a JSON list or a list cut by bars; null where a JSON list holds no strings."""
    t = F.trim(F.coalesce(c, F.lit("")))
    raw = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(t, r"\|"))
    bad = t.startswith("[") & ~t.rlike(r'^\[\s*("([^"\\]|\\.)*"(\s*,\s*"([^"\\]|\\.)*")*)?\s*\]$')
    return F.when(~bad, F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")))


def text_key(c: Column) -> Column:
    """White space collapsed, lower case: the key by which equal texts are found."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def lexical_key(c: Column) -> Column:
    """Lower-case words joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"((?U)\w+)"), 1), " ")


def quality_input_text(review: Column, title: Column, description: Column) -> Column:
    """The three parts that a quality encoder reads, one a line."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.concat(F.lit("Review: "), clean(review), F.lit("\nProduct title: "), clean(title), F.lit("\nProduct description: "), clean(description))


def quality_input_parts(text: Column) -> Column:
    """Review, title and description of a text in the form of ``quality_input_text``; any other text is a review alone."""
    names = ("Review: ", "Product title: ", "Product description: ")
    lines = F.split(text, "\n")
    whole = F.size(lines) == 3
    for i, n in enumerate(names):
        whole = whole & F.coalesce(F.startswith(F.get(lines, F.lit(i)), F.lit(n)), F.lit(False))
    part = lambda i, other: F.when(whole, F.substring(F.get(lines, F.lit(i)), len(names[i]) + 1, 2**31 - 1)).otherwise(other)
    return F.struct(part(0, F.trim(F.regexp_replace(text, r"(?U)\s+", " "))).alias("review"), part(1, F.lit("")).alias("title"), part(2, F.lit("")).alias("description"))


def quality_input_pair(review: Column, title: Column, description: Column, max_length: Column, specials: int = 4) -> Column:
    """Review and context cut to the budgets of ``context_budget``, counted in words between spaces.

    The title comes first and takes no more than its own budget, the description what is left of the
    context, and the review all tokens that the context leaves.
    """
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), " "), lambda x: x != "")
    b = context_budget(max_length, specials)
    t = F.slice(words(title), F.lit(1), b["title"])
    context = F.concat(t, F.slice(words(description), F.lit(1), F.greatest(F.lit(0), b["context"] - F.size(t))))
    return F.struct(F.array_join(F.slice(words(review), F.lit(1), b["content"] - F.size(context)), " ").alias("review"), F.array_join(context, " ").alias("context"))


def aspect_prompt(category: Column) -> Column:
    """A category and what it means."""
    return F.concat_ws(": ", category, F.element_at(F.create_map(*[F.lit(x) for kv in DEFINITIONS.items() for x in kv]), category))


def annotation_pairs(raw: Column, text: Column, exact: bool = False) -> Column:
    """Distinct ``aspect, sentiment`` indices of JSON annotations; null where one is invalid.

    ``exact`` also asks that each has exactly three fields, evidence that stands in the text, and a
    lower-case polarity.
    """
    items = F.from_json(raw, "array<string>")
    read = F.transform(items, lambda x: F.from_json(x, "category string, text string, sentiment string"))
    rows = F.transform(read, lambda x: F.struct((F.array_position(F.array(*map(F.lit, ASPECTS)), x["category"]) - 1).cast("int").alias("aspect"), map_polarity(x["sentiment"]).alias("sentiment"), x["text"].alias("text"), x["sentiment"].alias("name")))
    ok = items.isNotNull() & F.forall(rows, lambda x: (F.coalesce(x["aspect"], F.lit(-1)) >= 0) & x["sentiment"].isNotNull() & (F.trim(F.coalesce(x["text"], F.lit(""))) != ""))
    if exact:
        keys = F.array(F.lit("category"), F.lit("sentiment"), F.lit("text"))
        ok = ok & F.forall(items, lambda x: F.array_sort(F.json_object_keys(x)) == keys) & F.forall(rows, lambda x: F.contains(text, x["text"]) & x["name"].isin("negative", "neutral", "positive"))
    return F.when(ok, F.array_sort(F.array_distinct(F.transform(rows, lambda x: F.struct(x["aspect"].alias("aspect"), x["sentiment"].alias("sentiment"))))))


def context_budget(max_length: Column, specials: int = 4) -> Column:
    """Tokens for content, context, title and review under a length limit."""
    content = max_length - F.lit(specials)
    context = F.least(F.lit(CONTEXT_TOKENS), F.greatest(F.lit(2), F.floor(content / 4).cast("int")), content - 1)
    title = F.least(F.lit(TITLE_TOKENS), F.greatest(F.lit(1), F.floor(context * TITLE_TOKENS / CONTEXT_TOKENS).cast("int")))
    return F.struct(content.cast("int").alias("content"), context.cast("int").alias("context"), title.cast("int").alias("title"), (content - context).cast("int").alias("review"))


def parse_annotations(c: Column) -> Column:
    """JSON annotations grouped by category and polarity, in report order, with distinct evidence in its order; null if any is invalid."""
    raw = F.from_json(c, ANNOTATIONS)
    rows = F.transform(raw, lambda x: F.struct(F.array_position(F.array(*map(F.lit, ASPECTS)), F.trim(x["category"])).cast("int").alias("a"), map_polarity(x["sentiment"]).alias("s"), F.trim(x["text"]).alias("t")))
    ok = raw.isNotNull() & F.forall(rows, lambda x: (F.coalesce(x["a"], F.lit(0)) > 0) & x["s"].isNotNull() & (F.coalesce(x["t"], F.lit("")) != ""))
    keys = F.array_sort(F.array_distinct(F.transform(rows, lambda x: F.struct(x["a"].alias("a"), x["s"].alias("s")))))
    return F.when(
        ok,
        F.transform(
            keys,
            lambda k: F.struct(
                F.element_at(F.array(*map(F.lit, ASPECTS)), k["a"]).alias("category"),
                k["s"].alias("sentiment"),
                F.array_distinct(F.transform(F.filter(rows, lambda x: (x["a"] == k["a"]) & (x["s"] == k["s"])), lambda x: x["t"])).alias("evidence"),
            ),
        ),
    )


def argmax(c: Column) -> Column:
    """Index from 0 of the first greatest element."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def sentiment_selected(p: Column, threshold: float) -> Column:
    """Indices of all chances at the threshold or above, else of the first greatest."""
    over = F.filter(F.transform(p, lambda x, i: F.when(x >= threshold, i)), lambda x: x.isNotNull())
    return F.when(F.size(over) > 0, over).otherwise(F.array(argmax(p)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
