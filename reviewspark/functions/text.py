"""Text expressions: lexicon hits, the heuristic classifier, evidence segments, excerpts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Connectors that begin a clause.
CONNECTORS = ("pero", "kaso", "ngunit", "subalit", "but", "however", "yet", "although", "though", "while", "kasi", "dahil", "because", "since")


@dataclass(frozen=True)
class Lexicon:
    """Words of the heuristic classifier, and below how many tokens a delivery review is irrelevant."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    delivery: tuple[str, ...]
    product: tuple[str, ...]
    generic: tuple[str, ...] = ()
    delivery_tokens: int = 18


#: The words of the page's own classifier.
DEFAULT = Lexicon(
    positive=("good", "great", "best", "love", "excellent", "perfect", "comfortable", "clear", "quality", "worth", "nice", "sulit", "maganda", "maayos", "malinaw", "matibay", "ganda", "okay", "ayos", "recommend"),
    negative=("bad", "poor", "broken", "fake", "damaged", "disappointed", "waste", "uncomfortable", "mahina", "pangit", "sira", "mali", "sayang", "hindi gumagana", "defective", "kulang", "madumi"),
    delivery=("delivery", "shipping", "courier", "rider", "parcel", "dumating", "mabilis dumating", "seller responsive", "packaging"),
    product=("quality", "matibay", "durable", "material", "build", "battery", "sound", "audio", "camera", "gumagana", "price", "presyo", "mahal", "affordable", "color", "kulay", "design", "size", "laki"),
    generic=("good product", "nice product", "okay", "ok", "good quality", "recommended", "highly recommended", "perfect product", "maganda", "maayos", "sulit"),
)


# Fixed value: what a word of the classifier consists of.
TOKEN = "([a-zà-ž0-9]+)"


def word_hits(lowered: Column, terms: tuple[str, ...], tokens: Column | None = None) -> Column:
    """How many of the terms occur as whole words. Terms of one word are looked up among the tokens, all at once."""
    tokens = F.regexp_extract_all(lowered, F.lit(TOKEN), 1) if tokens is None else tokens
    single = [t for t in terms if " " not in t]
    found = F.size(F.array_intersect(tokens, F.array(*map(F.lit, single)))) if single else F.lit(0)
    phrase = lambda t: F.coalesce(lowered.rlike(rf"(^|[^a-zà-ž0-9])\Q{t}\E($|[^a-zà-ž0-9])"), F.lit(False)).cast("int")
    return sum((phrase(t) for t in terms if " " in t), F.greatest(found, F.lit(0)))


def classify(text: Column, rating: Column, words: Lexicon) -> Column:
    """The rule ladder of the page's own classifier: struct of label, sentiment, tokens and hits.

    Text is cut into tokens once, and hits are counted once for all rules that ask for them.
    """
    low = F.coalesce(F.lower(F.trim(text)), F.lit(""))
    cut = F.array(F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(TOKEN), 1).alias("tokens")))
    hits = F.transform(cut, lambda x: F.struct(x["low"].alias("low"), F.size(x["tokens"]).alias("n"), *[word_hits(x["low"], w, x["tokens"]).alias(k) for k, w in (("pos", words.positive), ("neg", words.negative), ("delivery", words.delivery), ("product", words.product))]))

    def judge(h: Column) -> Column:
        generic = F.lit(False)
        for g in words.generic:
            generic = generic | (h["low"] == g) | (h["low"] == g + "!") | ((h["n"] <= 6) & h["low"].contains(g))
        label = (
            F.when(h["low"] == "", "unavailable")
            .when((h["n"] <= 4) | (F.length(h["low"]) < 24) | generic, "liv")
            .when((h["delivery"] > 0) & (h["product"] == 0) & (h["n"] < words.delivery_tokens), "irrelevant")
            .when(((rating >= 4) & (h["neg"] > h["pos"])) | ((rating <= 2) & (h["pos"] > h["neg"])), "deceptive")
            .otherwise("authentic")
        )
        mood = F.when(h["low"] == "", F.lit(None)).when(h["pos"] == h["neg"], "neutral").when(h["pos"] > h["neg"], "positive").otherwise("negative")
        return F.struct(label.alias("label"), mood.alias("sentiment"), h["n"].alias("tokens"), h["pos"].alias("pos"), h["neg"].alias("neg"))

    return F.transform(hits, judge)[0]


# Where sentences end, and the characters that are trimmed from pieces (Unicode's space separators).
SENTENCE_END = r"(?<=[.!?…])\s+|\n+"
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def sentences(c: Column, end: str = SENTENCE_END) -> Column:
    """Pieces cut at white space after an end mark, and at line ends."""
    return F.filter(F.transform(F.split(c, end), _trim), lambda x: x != "")


def has_segments(c: Column) -> Column:
    """Whether ``evidence_segments`` finds anything: texts of spaces, line ends and its own mark alone hold nothing."""
    return c.rlike(rf"[^\n\u0001{SPACES}]")


def evidence_segments(c: Column, as_sql: bool = False) -> Column:
    """Sentences, cut before connectors, then after ``;`` and ``|``, and where over 20 words remain after commas; one empty piece where there is none.

    ``as_sql`` reads as the queries' SQL: a vertical tab is no white space, a connector ends before any character but an
    ASCII letter, digit or underscore, and takes that one in, so that another right behind it begins no clause.
    """
    mark, white = "\u0001", r"[\t\n\f\r ]" if as_sql else r"\s"
    words = "|".join(CONNECTORS).replace("k", "[k\u212a]").replace("s", "[s\u017f]")  # the letters' other forms, which (?i) leaves out
    cut = lambda xs, f: F.filter(F.flatten(F.transform(xs, lambda x: F.transform(F.split(f(x), mark), _trim))), lambda x: x != "")
    if as_sql:
        clauses = cut(sentences(c, SENTENCE_END.replace(r"\s", white)), lambda x: F.regexp_replace(F.concat(x, F.lit(" ")), rf"(?i){white}+(({words})[^0-9A-Za-z_\u017f\u212a])", mark + "$1"))
    else:
        clauses = cut(sentences(c), lambda x: F.regexp_replace(x, rf"(?i)\s+(?=({words})\b)", mark))
    parts = cut(clauses, lambda x: F.regexp_replace(x, rf"({white}*[;|]){white}*", "$1" + mark))
    out = cut(parts, lambda x: F.when(F.size(F.split(x, rf"{white}+")) > 20, F.regexp_replace(x, ",", "," + mark)).otherwise(x))
    # Bound once: a plain "when" would work the whole expression out for the test and again for the result.
    return F.transform(F.array(out), lambda xs: F.when(F.size(xs) > 0, xs).otherwise(F.array(F.lit(""))))[0]


def excerpt(c: Column, query: str) -> Column:
    """A window of max(320, len(query) + 80) characters from 80 before the first match, with ellipses."""
    limit = max(320, len(query) + 80)
    at = F.locate(query.lower(), F.lower(c))
    start = F.greatest(F.lit(1), at - 80)
    piece = c.substr(start, F.lit(limit))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.when(start > 1, "…").otherwise(""), F.trim(piece), F.when(start + limit - 1 < F.length(c), "…").otherwise("")))


def highlight(c: Column, query: str) -> Column:
    """HTML-escaped text with the matches of ``query`` marked."""
    safe = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.regexp_replace(safe, rf"(?i)(\Q{query}\E)", "<mark>$1</mark>") if query else safe
