"""Small expressions of pages and panels: numbers as shown, addresses, ratings and dates in text, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of classes, patterns of dates, of lines that are no review text, of seller replies, of product pages.
TITLES = {"authentic": "Authentic", "liv": "Low-value", "irrelevant": "Irrelevant", "deceptive": "Deceptive", "unavailable": "Not analyzed"}
REVIEW_DATE = r"\b20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}(?:\s+\d{1,2}:\d{2})?\b"
NOISE_LINES = (
    r"^[\w.*-]*\*{2,}[\w.*-]*$",
    r"^[\w.*-]*\*{2,}[\w.*-]*\s*20\d{2}[-/.]",
    r"^20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}(?:\s+\d{1,2}:\d{2})?(?:\s*\|.*)?$",
    r"(?i)^(?:variation|variant)\s*:",
    r"^(?:\d{1,2}:\d{2}\s*)+$",
    r"(?i)^(?:helpful|report|like|reply)(?:\s*\d+)?$",
    r"^\d+$",
)
SELLER_REPLY = r"(?i)^(?:seller|shop|merchant)\s*(?:reply|response)|^(?:reply|response)\s+from\s+(?:seller|shop)|^(?:tugon|sagot)\s+(?:ng|mula sa)\s+(?:seller|shop|tindahan)"
RATING = r"(?i)(?:^|\s)([1-5](?:\.\d)?)\s*(?:out of 5|stars?|/\s*5)(?:\s|$)"
PRODUCT_PAGES = {"shopee": (r"(?i)(^|\.)shopee\.ph$", r"(?i)(?:-i\.|/product/|/product\.)\d+"), "lazada": (r"(?i)(^|\.)lazada\.com\.ph$", r"(?i)/products/.+-i\d+")}


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves up; 0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0)).otherwise(F.floor(part / whole * 100 + 0.5)).cast("int")


def status_band(total: Column, share: Column) -> Column:
    """What the share of authentic reviews is called."""
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.coalesce(share, F.lit(0.0)) + 0.5)))
    return F.when(total == 0, "No eligible reviews").when(s >= 75, "Mostly authentic reviews").when(s >= 50, "Mixed review quality").otherwise("Few authentic reviews")


def metric_score(x: Column) -> Column:
    """A share as a percentage with two digits; anything else was not evaluated."""
    return F.when(~F.isnan(x) & x.between(0, 1), F.format_string("%.2f%%", x * 100)).otherwise("Not evaluated")


def verdict_title(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TITLES.items():
        out = F.when(label == k, v).otherwise(out)
    return F.coalesce(out, label)


def minutes_since(then: Column, now: Column) -> Column:
    """Whole minutes, never negative; null without a scan."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000))).cast("bigint")


def signature(parts: list[Column]) -> Column:
    """What tells whether a review changed."""
    return F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return F.transform(x, lambda v: 1 / (1 + F.exp(-v)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    n = F.sqrt(dot(x, x))
    return F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(v))


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors of one length."""
    total = F.aggregate(vectors, F.transform(vectors[0], lambda v: v * 0.0), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda v: v / F.size(vectors))


def rating_in_text(c: Column) -> Column:
    """A rating such as ``4 stars``, ``4.5 out of 5`` or ``4/5``; null without one."""
    return F.nullif(F.regexp_extract(c, RATING, 1), F.lit("")).cast("double")


def rating_of_width(style: Column) -> Column:
    """Stars of a bar's width in percent, from 1 to 5."""
    w = F.nullif(F.regexp_extract(style, r"(?i)width\s*:\s*(\d{1,3})%", 1), F.lit("")).cast("int")
    return F.when(w.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.floor(w / 20 + 0.5)))).cast("int")


def has_review_date(c: Column) -> Column:
    return F.coalesce(c.rlike(REVIEW_DATE), F.lit(False))


def body_text(c: Column) -> Column:
    """Lines of a review card that are text, joined: masked names, dates, variations and counters go."""
    lines = F.filter(F.transform(F.split(c, r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.array_join(F.filter(lines, lambda x: ~reduce(lambda a, p: a | x.rlike(p), NOISE_LINES, F.lit(False))), " ")


def seller_reply(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(SELLER_REPLY), F.lit(False))


def web_url(c: Column) -> Column:
    """A trimmed, unquoted address of http or https; null for any other."""
    u = F.regexp_replace(F.trim(c), "^['\"]|['\"]$", "")
    return F.when(u.rlike(r"(?i)^https?://[^/\s?#]+"), u)


def safe_url(c: Column) -> Column:
    """Whether an address is http or https, without a user part and not of a local or private host by name."""
    host = F.lower(F.coalesce(F.regexp_extract(c, r"(?i)^https?://([^/?#:@\s]+)(?::\d+)?(?:[/?#]|$)", 1), F.lit("")))
    return (host != "") & ~host.rlike(r"^(localhost|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)|\.local$|^\[")


def product_page(url: Column) -> Column:
    """Name of the market whose product page an address is, or null."""
    host, path = F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1), F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    out = F.lit(None).cast("string")
    for name, (h, p) in PRODUCT_PAGES.items():
        out = F.when(host.rlike(h) & path.rlike(p), name).otherwise(out)
    return out
