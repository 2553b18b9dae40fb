"""Reviews and product details of market pages: a page is a row of its nodes, and all rules are expressions over them.

``page_nodes`` is the only Python step: it turns HTML into an array of nodes in document order, and indexes them in one
pass: where a node's text stands in the page's, which part it plays by the adapters (plain data), and the nearest
node around it that plays some part. What is a review card, a text, a rating, a name or an image is decided in
expressions over that array, cut to a card's own nodes first, so a page never leaves its row, nothing is shuffled and the work grows with the nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.functions import panel as P

#: A node: its place, that of its last descendant and of its parent; tag, class, attributes, own text; where its text starts and ends in the
#: page's; element children; dates in its text, the length of such a text without further white space, and whether no child holds a date; for each market the first rule of each part that it meets (-1: none), and the
#: nearest node around it, itself included, that plays each of the parts in AROUND (-1: none).
NODE = "i int, last int, up int, tag string, cls string, a map<string,string>, t string, s int, e int, kids int, dates int, chars int, dated boolean, part array<tinyint>, near array<int>"
# Elements whose text stands on lines of its own, and elements without an end.
BLOCKS = frozenset(("div", "p", "section", "article", "li", "br", "dt", "dd", "header", "footer"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
MOST, IMAGES, TITLE, DESCRIPTION, BODY = 20, 5, 500, 2000, 2000

Rule = tuple[str, ...]
# Which nodes play which part, by market. A rule is ("tag", name), ("class", word), ("class_has", piece),
# ("attr", name), ("attr_has", name, piece), ("meta", attribute, value) or ("within", class piece, then a rule).
SELLER: tuple[Rule, ...] = (("class_has", "seller-reply"), ("class_has", "seller-response"), ("class_has", "shop-reply"), ("class_has", "merchant-reply"), ("attr_has", "data-testid", "seller-reply"), ("attr_has", "data-testid", "seller-response"))
NOT_TEXT: tuple[Rule, ...] = (
    ("tag", "script"), ("tag", "style"), ("tag", "button"), ("tag", "svg"), ("tag", "img"), ("tag", "video"), ("tag", "time"), ("attr", "hidden"), ("attr_has", "aria-hidden", "true"), ("attr_has", "aria-label", "star"), ("class_has", "star"), ("class_has", "username"), ("class_has", "author"),
    ("class_has", "date"), ("class_has", "time"), ("class_has", "variation"), ("class_has", "like"), ("class_has", "action"), ("class_has", "video-duration"), ("class_has", "media-duration"),
)
ADAPTERS: dict[str, dict[str, tuple[Rule, ...]]] = {
    "shopee": {
        "review": (("class_has", "shopee-product-rating"), ("class_has", "review-item"), ("class_has", "rating-item"), ("attr_has", "data-testid", "review-item"), ("attr_has", "data-testid", "rating-item")),
        "username": (("class", "shopee-product-rating__author-name"), ("class_has", "rating__author-name"), ("class_has", "review-author"), ("class_has", "username"), ("attr_has", "data-testid", "review-author")),
        "content": (("class", "shopee-product-rating__content"), ("class", "shopee-product-rating__comment"), ("class_has", "rating__content"), ("class_has", "review-comment"), ("class_has", "review-content"), ("class_has", "review-text"), ("attr_has", "data-testid", "review-content"), ("attr_has", "data-testid", "review-comment")),
        "rating": (("class", "shopee-product-rating__rating"), ("class_has", "rating__rating"), ("attr_has", "aria-label", "star")),
        "image": (("within", "shopee-product-rating__image-list-wrapper", "tag", "img"), ("within", "shopee-product-rating__image-list-wrapper", "attr_has", "style", "background-image"), ("within", "rating-media", "tag", "img"), ("within", "review-image", "tag", "img")),
        "seller": (*SELLER, ("class_has", "seller-comment")),
        "title": (("meta", "property", "og:title"), ("tag", "h1"), ("class_has", "product-title"), ("class_has", "product-name")),
        "description": (("class", "shopee-product-detail__description"), ("class_has", "product-description")),
        "score": (("class", "product-rating-overview__briefing"), ("within", "rating-overview", "class_has", "score"), ("class_has", "product-rating")),
    },
    "lazada": {
        "review": (("within", "mod-reviews", "class", "item"), ("class", "review-item"), ("class_has", "review-item")),
        "username": (("class_has", "review-author"), ("class_has", "username"), ("attr_has", "data-testid", "review-author")),
        "content": (("class", "item-content"), ("class", "review-content-sl"), ("class_has", "review-content"), ("class_has", "review-comment")),
        "rating": (("class", "starCtn"), ("class_has", "review-star"), ("attr_has", "aria-label", "star")),
        "image": (("within", "review-image", "tag", "img"), ("within", "item-content", "tag", "img"), ("within", "review-media", "tag", "img")),
        "seller": SELLER,
        "title": (("meta", "property", "og:title"), ("class", "pdp-mod-product-badge-title"), ("class", "pdp-product-title"), ("tag", "h1")),
        "description": (("class", "pdp-product-desc"), ("class", "html-content"), ("class_has", "product-desc")),
        "score": (("class", "score-average"), ("class", "pdp-review-summary__link"), ("within", "rating", "class_has", "score")),
    },
}
# What names, profile links and images of other things look like.
HANDLE, NO_HANDLE = r"^[\p{L}\p{N}_.\-*•]{2,100}$", r"(?i)^(?:verified|purchase|helpful|report|reply|follow|variation|seller|shop|like|star|stars)$"
PROFILE, NO_PROFILE = r"(?i)^/(?:user|profile)/[\w.-]+/?$|^/[\w.-]{2,100}/?$", r"(?i)^/(?:shop|help|product|products|reviews|login)/?$"
NO_IMAGE = r"avatar|profile|seller|shop|logo|icon|star|emoji"
#: Parts that don't depend on the market.
COMMON: dict[str, tuple[Rule, ...]] = {
    "mark": (("attr", "data-review-id"), ("attr", "data-rating-id"), ("class", "shopee-product-rating"), ("class", "review-item"), ("within", "mod-reviews", "class", "item")),
    "list": (("class_has", "mod-reviews"), ("class_has", "review-list"), ("attr_has", "data-testid", "review-list")),
    "star": (("attr_has", "aria-label", "star"), ("attr", "data-rating"), ("attr", "data-star-rating")),
    "body": (("tag", "p"), ("class_has", "review-content"), ("class_has", "review-comment"), ("class_has", "review-text")),
    "hidden": (("attr", "hidden"), ("attr_has", "aria-hidden", "true"), ("tag", "button"), ("tag", "time"), ("class_has", "badge"), ("class_has", "verified")),
    "strip": (("tag", "script"), ("tag", "style"), ("tag", "svg"), ("class_has", "badge"), ("class_has", "verified")),
    "plain": (("tag", "img"), ("attr_has", "style", "background-image"), ("attr", "poster")),
    "detail": (("class", "shopee-product-rating"), ("class_has", "product-detail")),
}
PARTS = ("review", "username", "content", "rating", "image", "seller", "score", "gone", *COMMON)
#: Parts whose nearest node around a node is known.
AROUND = ("gone", "seller", "hidden", "strip", "content", "list", "review")


def _test(rule: Rule) -> Callable[[str, str, dict[str, str], list[str]], bool]:
    """Whether an element (tag, class, attributes, classes around it) meets a rule."""
    kind, *v = rule
    if kind == "within":
        inner = _test(tuple(v[1:]))
        return lambda tag, cls, a, around: any(v[0] in c for c in around) and inner(tag, cls, a, around)
    return {
        "tag": lambda tag, cls, a, around: tag == v[0],
        "class": lambda tag, cls, a, around: f" {v[0]} " in f" {cls} ",
        "class_has": lambda tag, cls, a, around: v[0] in cls,
        "attr": lambda tag, cls, a, around: v[0] in a,
        "attr_has": lambda tag, cls, a, around: v[1] in a.get(v[0], "").lower(),
        "meta": lambda tag, cls, a, around: tag == "meta" and a.get(v[0], "") == v[1],
    }[kind]


def _tests(market: str) -> list[list[Callable]]:
    """The tests of each part of a market, in order."""
    adapter = ADAPTERS[market] | COMMON
    adapter["gone"] = (*ADAPTERS[market]["rating"], *ADAPTERS[market]["username"], *NOT_TEXT)
    return [[_test(r) for r in adapter[p]] for p in PARTS]


class _Nodes(HTMLParser):
    """Elements and texts in document order as rows of ``NODE``."""

    date, year = re.compile(P.REVIEW_DATE, re.ASCII), re.compile(r"20\d{2}[-/.]", re.ASCII)

    def __init__(self, tests: list[list[list[Callable]]]) -> None:
        super().__init__(convert_charrefs=True)
        self.tests, self.rows, self.open, self.size = tests, [], [], 0

    def add(self, tag: str, attrs: list[tuple[str, str | None]], text: str) -> int:
        a, at, up = {k: v or "" for k, v in attrs}, len(self.rows), self.open[-1] if self.open else -1
        cls = a.get("class", "")
        none = len(PARTS) * len(self.tests)
        around = self.rows[up][14] if up >= 0 else [-1] * (len(AROUND) * len(self.tests))
        if tag == "#text":
            part, near = [-1] * none, around
        else:
            classes = [self.rows[i][4] for i in self.open]
            part = [next((k for k, t in enumerate(ts) if t(tag, cls, a, classes)), -1) for market in self.tests for ts in market]
            near = [at if part[m * len(PARTS) + PARTS.index(p)] >= 0 else around[m * len(AROUND) + k] for m in range(len(self.tests)) for k, p in enumerate(AROUND)]
            if up >= 0:
                self.rows[up][9] += 1
        self.rows.append([at, at, up, tag, cls, list(a.items()), text, self.size, self.size + len(text), 0, 0, 0, False, part, near])
        self.size += len(text)
        return at

    def end(self, i: int) -> None:
        self.rows[i][1], self.rows[i][8] = len(self.rows) - 1, self.size

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = self.add(tag, attrs, "")
        if tag not in VOID:
            self.open.append(at)
        if tag in BLOCKS:
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[i][3] == tag for i in self.open):
            while self.open:
                i = self.open[-1]
                if self.rows[i][3] in BLOCKS:
                    self.handle_data("\n")
                self.open.pop()
                self.end(i)
                if self.rows[i][3] == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.add("#text", [], data)

    def done(self) -> tuple[str, list[tuple]]:
        self.close()
        for i in self.open:
            self.end(i)
        text = "".join(r[6] for r in self.rows)
        years = [m.start() for m in self.year.finditer(text)]
        held = set()  # nodes a child of which holds a date
        for r in reversed(self.rows):
            if r[3] != "#text" and bisect_left(years, r[7]) < bisect_left(years, r[8]):
                own = " ".join(text[r[7] : r[8]].split())
                r[10], r[11] = len(self.date.findall(own)), len(own)
                r[12] = r[10] > 0 and r[0] not in held
                if r[10]:
                    held.add(r[2])
        return text, [tuple(r) for r in self.rows]


def page_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``page_text`` and ``nodes`` (array of ``NODE``) to pages and drops the HTML; a null page has no nodes."""
    keep = [c for c in pages.columns if c != html]
    fields = ",".join(x.strip().replace(" ", ":", 1) for x in re.split(r", (?=\w+ )", NODE))
    schema = pages.select(*keep, F.lit("").alias("page_text"), F.lit(None).cast(f"array<struct<{fields}>>").alias("nodes")).schema
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int8()), pa.list_(pa.int32()))
    kind = pa.list_(pa.struct([(f.name, k) for f, k in zip(schema["nodes"].dataType.elementType, kinds, strict=True)]))
    names = [f.name for f in kind.value_type]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [_tests(m) for m in ADAPTERS]
        for b in it:
            for lo in range(0, b.num_rows, 100):
                some, texts, out = b.slice(lo, 100), [], []
                for h in some.column(some.num_columns - 1).to_pylist():
                    parser = _Nodes(tests)
                    parser.feed(h or "")
                    text, rows = parser.done()
                    texts.append(text)
                    out.append([dict(zip(names, r, strict=True)) for r in rows])
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string()), pa.array(out, kind)], names=schema.names)

    return pages.select(*keep, html).mapInArrow(run, schema)


def _rule(n: Column, rule: Rule) -> Column:
    """A rule as an expression, for rules of whole pages."""
    kind, *v = rule
    a = lambda k: F.coalesce(F.try_element_at(n["a"], F.lit(k)), F.lit(""))
    return {
        "tag": lambda: n["tag"] == v[0],
        "class": lambda: F.contains(F.concat(F.lit(" "), n["cls"], F.lit(" ")), F.lit(f" {v[0]} ")),
        "class_has": lambda: F.contains(n["cls"], F.lit(v[0])),
        "attr_has": lambda: F.contains(F.lower(a(v[0])), F.lit(v[1])),
        "meta": lambda: (n["tag"] == "meta") & (a(v[0]) == v[1]),
    }[kind]()


class Market:
    """The parts of nodes by one market's rules."""

    def __init__(self, name: str) -> None:
        self.name, self.adapter, self.at = name, ADAPTERS[name], list(ADAPTERS).index(name)

    def rank(self, n: Column, part: str) -> Column:
        """The first rule of a part that a node meets, or -1."""
        return F.get(n["part"], F.lit(self.at * len(PARTS) + PARTS.index(part)))

    def plays(self, n: Column, part: str) -> Column:
        return self.rank(n, part) >= 0

    def near(self, n: Column, part: str) -> Column:
        """Place of the nearest node around a node, itself included, that plays a part, or -1."""
        return F.get(n["near"], F.lit(self.at * len(AROUND) + AROUND.index(part)))


def inside(n: Column, outer: Column) -> Column:
    return (n["i"] > outer["i"]) & (n["i"] <= outer["last"])


def within(n: Column, outers: Column) -> Column:
    return F.exists(outers, lambda o: (n["i"] >= o["i"]) & (n["i"] <= o["last"]))


def text_of(text: Column, n: Column, start: Column | int = 0) -> Column:
    """Text below a node, out of a text that starts at ``start`` in the page's."""
    return F.substr(text, n["s"] - start + 1, n["e"] - n["s"])


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def below(nodes: Column, card: Column) -> Column:
    """A card's own nodes, the card first."""
    return F.slice(nodes, card["i"] + 1, card["last"] - card["i"] + 1)


def attribute(n: Column, name: str) -> Column:
    """An attribute of a node, null where it is blank."""
    return F.nullif(F.try_element_at(n["a"], F.lit(name)), F.lit(""))


def top_level(found: Column) -> Column:
    """Nodes that stand in no other of them: those that start behind all that came before."""
    step = lambda s, n: F.when(n["i"] > s["last"], F.struct(n["last"].alias("last"), F.concat(s["all"], F.array(n["i"])).alias("all"))).otherwise(s)
    first = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("all"))
    return let(F.aggregate(found, first, step, lambda s: s["all"]), lambda at: F.filter(found, lambda n: F.array_contains(at, n["i"])))


def credible(nodes: Column, n: Column, m: Market) -> Column:
    """Whether a node that looks like a review card is one."""
    own = lambda part: F.exists(F.slice(nodes, n["i"] + 2, n["last"] - n["i"]), lambda x: m.plays(x, part))
    return m.plays(n, "mark") | (n["dates"] > 0) | ((m.near(n, "list") >= 0) & own("star") & own("body"))


def dated_cards(nodes: Column) -> Column:
    """Cards around dates: from each innermost date at most eight parents up, the outermost with one date and 20 to 2,500 characters ."""
    state = lambda at, going, best: F.struct(at.cast("int").alias("at"), going.alias("going"), best.cast("int").alias("best"))

    def climb(s: Column, _: Column) -> Column:
        a = F.get(nodes, F.when(s["at"] >= 0, s["at"]))
        go = F.coalesce(s["going"] & (s["at"] >= 0) & (a["dates"] <= 1), F.lit(False))
        return state(F.when(go, a["up"]).otherwise(F.lit(-1)), go, F.when(go & (a["dates"] == 1) & a["chars"].between(20, 2500), a["i"]).otherwise(s["best"]))

    best = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(8)), state(n["up"], F.lit(True), F.lit(-1)), climb, lambda s: s["best"])
    markers = F.filter(nodes, lambda n: n["dated"] & n["tag"].isin("time", "span", "div", "p"))
    return let(F.array_sort(F.array_distinct(F.transform(markers, best))), lambda at: F.transform(F.filter(at, lambda i: i >= 0), lambda i: F.get(nodes, i)))


def cards(nodes: Column, m: Market) -> Column:
    """Review cards of a page, each with its own nodes: known ones that are credible, else those around dates."""
    known = top_level(F.filter(F.filter(nodes, lambda n: m.plays(n, "review")), lambda n: credible(nodes, n, m)))
    found = let(known, lambda k: F.when(F.size(k) > 0, k).otherwise(top_level(dated_cards(nodes))))
    return F.transform(found, lambda c: F.struct(c.alias("card"), below(nodes, c).alias("own")))


def seller_replies(own: Column, card: Column, text: Column, m: Market) -> Column:
    """Nodes of a card that hold what the seller answered: by their marks, or around a lone text that says so."""
    alone = lambda n: (n["kids"] == 0) & n["tag"].isin("div", "section", "article", "p", "span") & P.seller_reply(clean(text_of(text, n, card["s"])))
    parents = F.transform(F.filter(own, alone), lambda n: F.when(n["up"] == card["i"], n["i"]).otherwise(n["up"]))
    return let(parents, lambda up: F.filter(own, lambda n: m.plays(n, "seller") | F.array_contains(up, n["i"])))


def card_text(own: Column, card: Column, text: Column, m: Market, replies: Column, author: Column) -> Column:
    """The longest body of a card, without replies, ratings, names and counters; blank without any."""
    named = lambda x: F.coalesce((x["i"] >= author["i"]) & (x["i"] <= author["last"]), F.lit(False))

    def body(n: Column) -> Column:
        stays = lambda x: (x["tag"] == "#text") & inside(x, n) & (m.near(x, "gone") <= n["i"]) & ~named(x) & ~F.exists(replies, lambda o: (o["i"] > n["i"]) & (x["i"] >= o["i"]) & (x["i"] <= o["last"]))
        return P.body_text(F.array_join(F.transform(F.filter(F.slice(own, n["i"] - card["i"] + 1, n["last"] - n["i"] + 1), stays), lambda x: x["t"]), ""))

    found = F.transform(F.filter(own, lambda n: m.plays(n, "content") & ~within(n, replies)), body)
    bodies = let(F.filter(found, lambda t: F.length(t).between(1, BODY) & ~P.seller_reply(t)), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(body(card))))
    kept = F.filter(bodies, lambda t: ~t.rlike(r"^\d{1,2}[\s/:.-]"))
    return F.substring(F.aggregate(kept, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a)), 1, BODY)


def first_of(own: Column, m: Market, part: str) -> Column:
    """Of a card's inner nodes the first that meets the first rule of a part that any meets; null without one."""
    some = F.filter(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda n: m.plays(n, part))
    by = lambda n: F.struct(m.rank(n, part).alias("rank"), n["i"].alias("i"))
    return let(F.array_min(F.transform(some, by)), lambda best: F.get(F.filter(some, lambda n: n["i"] == best["i"]), F.lit(0)))


def card_rating(own: Column, card: Column, text: Column, m: Market) -> Column:
    """A stated rating, else filled stars, else the width of a bar."""
    said = lambda n: P.rating_in_text(F.concat_ws(" ", attribute(n, "aria-label"), attribute(n, "data-rating"), attribute(n, "data-star-rating"), text_of(text, n, card["s"])))
    stated = F.get(F.filter(F.transform(F.concat(F.array(card), F.filter(own, lambda n: m.plays(n, "rating"))), said), lambda x: x.isNotNull()), F.lit(0))
    filled = F.size(F.filter(own, lambda n: F.contains(n["cls"], F.lit("star")) & n["cls"].rlike("full|filled|active") | F.contains(n["cls"], F.lit("icon-rating-solid"))))
    width = P.rating_of_width(F.array_join(F.transform(own, lambda n: attribute(n, "style")), " "))
    return F.coalesce(stated, F.when(filled.between(1, 5), filled.cast("double")), width.cast("double"))


def card_author(own: Column, card: Column, m: Market, replies: Column, host: Column) -> Column:
    """``name, i, last`` of the node that names a card's author, or null: by its marks, else a link to a profile of the
    same host, else the first leaf before the rating that reads like a handle. Hidden nodes, badges, replies and, without marks, bodies name nobody."""
    free = lambda n: (n["i"] > card["i"]) & (m.near(n, "hidden") < 0) & ~within(n, replies)
    outside = lambda n: m.near(n, "content") <= card["i"]

    def read(n: Column) -> Column:
        parts = F.filter(F.slice(own, n["i"] - card["i"] + 1, n["last"] - n["i"] + 1), lambda x: (x["tag"] == "#text") & (m.near(x, "strip") <= n["i"]))
        return F.regexp_replace(clean(F.array_join(F.transform(parts, lambda x: x["t"]), "")), r"(?i)^by\s+", "")

    named = lambda ns, ok: F.filter(F.transform(ns, lambda n: F.struct(read(n).alias("name"), n["i"].alias("i"), n["last"].alias("last"), m.rank(n, "username").alias("rank"))), lambda x: ok(x["name"]))
    handle = lambda t: t.rlike(HANDLE) & ~t.rlike(NO_HANDLE)
    href = lambda n: F.coalesce(attribute(n, "href"), F.lit(""))
    path = lambda n: F.regexp_replace(href(n), r"^https?://[^/]+|[?#].*$", "")
    other = lambda n: F.coalesce(F.lower(F.nullif(F.regexp_extract(href(n), r"(?i)^https?://([^/?#:]+)", 1), F.lit(""))) != F.lower(host), F.lit(False)) | href(n).rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:")
    marked = named(F.filter(own, lambda n: m.plays(n, "username") & free(n)), lambda t: F.length(t).between(1, 100))
    linked = named(F.filter(own, lambda n: (n["tag"] == "a") & free(n) & outside(n) & ~other(n) & path(n).rlike(PROFILE) & ~path(n).rlike(NO_PROFILE)), handle)
    leaves = let(first_of(own, m, "rating"), lambda r: named(F.filter(own, lambda n: n["tag"].isin("a", "span", "div") & (n["kids"] == 0) & free(n) & outside(n) & F.coalesce(n["i"] < r["i"], F.lit(False))), handle))
    best = F.array_min(F.transform(marked, lambda x: F.struct(x["rank"].alias("rank"), x["i"].alias("i"), x["last"].alias("last"), x["name"].alias("name"))))
    pick = lambda x: F.struct(x["name"].alias("name"), x["i"].alias("i"), x["last"].alias("last"))
    return F.coalesce(let(best, lambda b: F.when(b.isNotNull(), pick(b))), F.get(F.transform(linked, pick), F.lit(0)), F.get(F.transform(leaves, pick), F.lit(0)))


def card_images(own: Column, m: Market, replies: Column) -> Column:
    """At most five different addresses of a card's images."""
    drawn = lambda n: F.nullif(F.regexp_extract(F.coalesce(attribute(n, "style"), F.lit("")), r"(?i)background-image\s*:\s*url\(([^)]+)\)", 1), F.lit(""))
    url = lambda n: P.web_url(F.coalesce(attribute(n, "src"), attribute(n, "data-src"), attribute(n, "data-ks-lazyload"), attribute(n, "poster"), drawn(n)))
    marked, plain = F.filter(own, lambda n: m.plays(n, "image")), F.filter(own, lambda n: m.plays(n, "plain"))
    chosen = let(marked, lambda x: F.when(F.size(x) > 0, x).otherwise(plain))
    shown = F.filter(chosen, lambda n: ~within(n, replies) & ~F.lower(F.concat_ws(" ", n["cls"], attribute(n, "alt"))).rlike(NO_IMAGE))
    return F.slice(F.array_distinct(F.filter(F.transform(shown, url), lambda u: u.isNotNull())), 1, IMAGES)


def page_reviews(pages: DataFrame, market: str, page: str = "page_id", url: str | None = None) -> DataFrame:
    """One row a review card of pages of a market: ``page, pos, id, username, text, rating, urls, seller_replies``.

    ``pages`` has ``page`` and what ``page_nodes`` adds; with ``url``, links to other hosts name nobody. Cards without text,
    rating and image, repeated texts and those beyond the limit are for ``panels.accepted`` to leave out.
    """
    m = Market(market)
    host = F.regexp_extract(F.col(url), r"(?i)^https?://([^/?#:]+)", 1) if url else F.lit(None).cast("string")
    whole = F.col("page_text")
    found = F.transform(cards(F.col("nodes"), m), lambda c: F.struct(c["card"].alias("card"), c["own"].alias("own"), text_of(whole, c["card"]).alias("text")))
    card = pages.select(page, host.alias("host"), F.posexplode(found).alias("pos", "c")).select(page, "host", "pos", "c.*")
    c, own, text, replies, author = (F.col(x) for x in ("card", "own", "text", "replies", "author"))
    card = card.withColumn("replies", seller_replies(own, c, text, m)).withColumn("author", card_author(own, c, m, replies, F.col("host")))
    return card.select(
        page, "pos", F.concat(F.lit(f"{market}-"), F.coalesce(attribute(c, "data-review-id"), attribute(c, "id"), (F.col("pos") + 1).cast("string"))).alias("id"), F.coalesce("author.name", F.lit("")).alias("username"),
        card_text(own, c, text, m, replies, author).alias("text"), card_rating(own, c, text, m).alias("rating"), card_images(own, m, replies).alias("urls"), F.size(replies).alias("seller_replies"),
    )


def page_details(pages: DataFrame, market: str, page: str = "page_id") -> DataFrame:
    """Title, description and overall rating of each page of a market (blank or null where it states none)."""
    m, nodes, whole = Market(market), F.col("nodes"), F.col("page_text")
    content = lambda n: F.when(n["tag"] == "meta", F.coalesce(F.try_element_at(n["a"], F.lit("content")), F.lit(""))).otherwise(text_of(whole, n))

    def met(rule: Rule) -> Column:
        return F.get(F.filter(F.transform(F.filter(nodes, lambda n: (n["tag"] != "#text") & _rule(n, rule)), lambda n: clean(content(n))), lambda t: t != ""), F.lit(0))

    def first(rules: tuple[Rule, ...]) -> Column:
        return F.coalesce(*[met(r) for r in rules], F.lit(None).cast("string"))

    page_title = clean(F.regexp_extract(F.coalesce(first((("tag", "title"),)), F.lit("")), r"^([^|–—]*)", 1))
    about = first((("meta", "property", "og:description"), ("meta", "name", "description"), ("attr_has", "itemprop", "description"), *m.adapter["description"]))
    stated = first((("meta", "itemprop", "ratingValue"), ("attr_has", "itemprop", "ratingvalue"), ("meta", "property", "product:rating:value"))).try_cast("double")
    told = F.transform(F.filter(nodes, lambda n: m.plays(n, "score")), lambda n: F.struct(m.rank(n, "score").alias("rank"), n["i"].alias("i"), F.nullif(F.regexp_extract(clean(text_of(whole, n)), r"^([1-5](?:\.[0-9])?)$", 1), F.lit("")).alias("x")))
    score = F.array_min(F.filter(told, lambda x: x["x"].isNotNull()))["x"].cast("double")
    return pages.select(page, F.substring(F.coalesce(first(m.adapter["title"]), page_title), 1, TITLE).alias("title"), F.substring(F.coalesce(about, F.lit("")), 1, DESCRIPTION).alias("description"), F.coalesce(F.when(stated.between(1, 5), stated), score).alias("rating"))


def linked_data(nodes: Column) -> Column:
    """The JSON-LD objects that a page embeds, as variants: of each script the object, or the members of its array or ``@graph``. Broken JSON gives none."""
    scripts = F.filter(nodes, lambda n: (n["tag"] == "script") & (F.lower(F.coalesce(F.try_element_at(n["a"], F.lit("type")), F.lit(""))) == "application/ld+json"))
    raw = F.transform(scripts, lambda n: F.get(nodes, n["i"] + 1)["t"])  # a script's text is its only child
    parsed = F.filter(F.transform(raw, lambda t: F.try_parse_json(t)), lambda v: v.isNotNull())
    many = lambda v, at: F.try_variant_get(v, at, "array<variant>")
    one = lambda v: let(F.coalesce(many(v, "$"), F.array(v)), lambda xs: F.flatten(F.transform(xs, lambda x: F.coalesce(many(x, '$["@graph"]'), F.array(x)))))
    return F.flatten(F.transform(parsed, one))


def linked_products(nodes: Column) -> Column:
    """Of the embedded objects those of type Product: name, description and rating."""
    text = lambda v, at: F.try_variant_get(v, at, "string")
    types = lambda v: F.coalesce(F.try_variant_get(v, '$["@type"]', "array<string>"), F.array(text(v, '$["@type"]')))
    product = lambda v: F.exists(types(v), lambda t: F.lower(F.coalesce(t, F.lit(""))) == "product")
    return F.transform(F.filter(linked_data(nodes), product), lambda v: F.struct(text(v, "$.name").alias("name"), text(v, "$.description").alias("description"), text(v, "$.aggregateRating.ratingValue").try_cast("double").alias("rating")))


def product_pages(pages: DataFrame, market: str, page: str = "page_id", url: str = "url") -> DataFrame:
    """Whether each page shows a product: ``by_url`` (host and path), ``by_schema`` (item type, embedded or open-graph type), ``by_mark`` (nodes of the market), and the first embedded product."""
    m, nodes = Market(market), F.col("nodes")
    a = lambda n, k: F.coalesce(F.try_element_at(n["a"], F.lit(k)), F.lit(""))
    typed = F.exists(nodes, lambda n: F.lower(a(n, "itemtype")).contains("schema.org/product"))
    said = F.exists(nodes, lambda n: (n["tag"] == "#text") & F.get(nodes, F.when(n["up"] >= 0, n["up"]))["tag"].eqNullSafe("script") & n["t"].rlike(r"""(?i)["']@type["']\s*:\s*["']Product["']""") & (a(F.get(nodes, n["up"]), "type") == "application/ld+json"))
    graph = F.exists(nodes, lambda n: (n["tag"] == "meta") & (a(n, "property") == "og:type") & F.lower(a(n, "content")).contains("product"))
    first = F.get(linked_products(nodes), F.lit(0))
    return pages.select(
        page, F.coalesce(P.product_page(F.col(url)) == market, F.lit(False)).alias("by_url"), F.coalesce(typed | said | graph, F.lit(False)).alias("by_schema"), F.coalesce(F.exists(nodes, lambda n: m.plays(n, "detail")), F.lit(False)).alias("by_mark"),
        first["name"].alias("name"), first["description"].alias("description"), first["rating"].alias("rating"),
    )
