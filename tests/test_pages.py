"""Pages as they come: names by place, other hosts, bodies, embedded data, and the time that large pages take."""

import json
import time

import pytest
from pyspark.sql import functions as F

from reviewspark.sources import pages


def found(spark, body, market="shopee", url="https://shopee.ph/product/12"):
    df = spark.createDataFrame([(1, url, f"<html><head><title>t</title></head><body>{body}</body></html>")], "page_id long, url string, html string")
    return pages.page_reviews(pages.page_nodes(df), market, url="url").orderBy("pos").collect()


def card(name, inner="", stars="<i aria-label='4 out of 5 stars'></i>", text="Sturdy lid and a good grip"):
    return f"<div class='review-item' data-review-id='x'>{name}{stars}<div class='review-content'>{text}{inner}</div></div>"


def test_names(spark):
    """One page of cards, so that one job judges all."""
    cases = [
        ("<span>m***e</span>", "m***e"),  # the first leaf before the rating
        ("<div><span>shop</span><span>real_one</span></div>", "real_one"),  # not a word that names parts of a page
        ("<span hidden>ghost</span><span>seen.one</span>", "seen.one"),
        ("<span class='verified'>badge1</span>", ""),
        ("<span><b>nested</b></span>", ""),  # has a child, and b is no candidate
        ("<span>two words</span>", ""),
        ("<a href='/user/abc'>linked-1</a>", "linked-1"),
        ("<a href='https://shopee.ph/abc?x=1'>linked-2</a>", "linked-2"),
        ("<b><a href='https://elsewhere.ph/user/abc'><i>away</i></a></b>", ""),  # another host
        ("<b><a href='javascript:void(0)'><i>away</i></a></b>", ""),
        ("<b><a href='/help'><i>away</i></a></b>", ""),
        ("<span class='review-author'>Ana B.</span><a href='/user/abc'>linked-3</a>", "Ana B."),  # marks come first
        ("<span class='username'>late</span><div class='shopee-product-rating__author-name'>by  first rule</div>", "first rule"),
        ("<span class='username'></span><span>leaf5</span>", "leaf5"),
        ("<div class='seller-reply'><a href='/user/s'>store1</a></div>", ""),
    ]
    got = found(spark, "".join(card(n).replace("'x'", f"'c{i}'") for i, (n, _) in enumerate(cases)))
    assert [(r.id, r.username) for r in got] == [(f"shopee-c{i}", name) for i, (_, name) in enumerate(cases)]


def test_leaves_behind_the_rating_and_in_bodies_name_nobody(spark):
    got = found(spark, card("", "<a href='/user/quoted'>quoted</a>") + card("", stars="<i aria-label='4 stars'></i><span>after</span>") + "<div class='review-item' id='none'><span>nobody</span><div class='review-text'>no rating here</div></div>")
    assert [r.username for r in got] == ["", "", ""]


def test_an_author_is_no_text(spark):
    body = "<div class='review-item' id='a'><div class='review-content'><a href='/u.1' class='x'>u.1</a> <span class='like'>9</span>Light <em class='date'>2024-01-02</em>and small</div><i aria-label='5 stars'></i></div>"
    (r,) = found(spark, body)
    assert (r.username, r.text, r.rating) == ("", "u.1 Light and small", 5.0)  # within the body it is no author
    outer = "<div class='review-item' id='a'><span>u.1</span><i aria-label='5 stars'></i><div>Light and small thing</div></div>"
    (r,) = found(spark, outer)
    assert (r.username, r.text) == ("u.1", "Light and small thing")


def test_cards_without_any_known_mark(spark):
    one = lambda name, day, text, extra="": f"<div class='q1'>{name}<img class='avatar' src='https://e/a.jpg'><div aria-label='5 out of 5 stars'></div><div class='w'><div>2025-03-{day} 10:20 | Variation: Red</div><div>{text}</div></div>{extra}</div>"
    reply = "<img src='https://e/own.jpg'><div class='seller-response'><strong>Seller Response</strong><p>We are glad that you like it.</p></div>"
    filters = "<nav><button class='rating-item'>5 Star (9)</button><button class='rating-item'>4 Star (2)</button></nav>"
    got = found(spark, f"<section>{filters}{one("<a href='/lena88'>lena88</a>", 11, 'Fits well and came in two days.', reply)}{one('<span>k*****2</span>', 12, 'Colour is a bit lighter than shown.')}</section>")
    assert [(r.username, r.text, r.rating, r.urls) for r in got] == [("lena88", "Fits well and came in two days.", 5.0, ["https://e/own.jpg"]), ("k*****2", "Colour is a bit lighter than shown.", 5.0, [])]


def test_marked_cards_of_both_markets(spark):
    shop = "<div class='shopee-product-rating' data-review-id='f1'><div><span class='shopee-product-rating__author-name'>n***a</span><img class='avatar' src='https://e/v.jpg'></div><div class='shopee-product-rating__rating' aria-label='5 out of 5 stars'></div><div class='shopee-product-rating__content'>Loud enough for a small room.</div><div class='shopee-product-rating__image-list-wrapper'><img src='https://e/b.jpg'></div><section class='seller-response'><p>A reply that is much longer than what the buyer wrote, on purpose.</p><img src='https://e/logo2.jpg'></section></div>"
    (r,) = found(spark, shop)
    assert (r.username, r.text, r.rating, r.urls, r.seller_replies) == ("n***a", "Loud enough for a small room.", 5.0, ["https://e/b.jpg"], 1)
    mod = "<section class='mod-reviews'><article class='item' data-review-id='f2'><div class='top'><div class='middle'><span class='username'>by Pia D.</span><span class='verified'>Verified Purchase</span></div></div><div class='starCtn' aria-label='4 out of 5 stars'></div><div class='item-content'>Worth its price.<div class='review-image'><img src='https://e/c.jpg'></div><div class='seller-reply'><strong>Seller Reply</strong><p>Longer text of the shop within the body, which must go.</p></div></div></article></section>"
    (r,) = found(spark, mod, "lazada")
    assert (r.username, r.text, r.rating, r.urls) == ("Pia D.", "Worth its price.", 4.0, ["https://e/c.jpg"])


def test_embedded_products(spark):
    ld = lambda x: f"<script type='application/ld+json'>{x if isinstance(x, str) else json.dumps(x)}</script>"
    product = {"@type": "Product", "name": "Lamp", "description": "Warm", "aggregateRating": {"ratingValue": "4.5"}}
    cases = {
        1: (ld(product), (True, "Lamp", 4.5)),
        2: (ld([{"@type": "Organization"}, product | {"name": "Second"}]), (True, "Second", 4.5)),
        3: (ld({"@context": "x", "@graph": [{"@type": "WebPage"}, product | {"@type": ["Thing", "Product"], "name": "Third"}]}), (False, "Third", 4.5)),
        4: (ld('{"@type": "Product", "name": broken'), (True, None, None)),
        5: (ld("") + ld({"@type": "BreadcrumbList"}), (False, None, None)),
        6: ("<div itemtype='https://schema.org/Product'></div>", (True, None, None)),
        7: ("<meta property='og:type' content='og:Product'>", (True, None, None)),
        8: ("<script>var x = {\"@type\": \"Product\"}</script>", (False, None, None)),
        9: (ld([{"@graph": [product | {"aggregateRating": None}]}]), (True, "Lamp", None)),
    }
    df = spark.createDataFrame([(k, "https://shopee.ph/x-i.1.2" if k == 1 else "https://e.org/", h) for k, (h, _) in cases.items()] + [(10, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.product_pages(pages.page_nodes(df), "shopee").collect()}
    assert {k: (got[k].by_schema, got[k].name, got[k].rating) for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert [k for k in got if got[k].by_url] == [1] and not any(r.by_mark for r in got.values()) and got[10].by_schema is False


@pytest.mark.parametrize("marked", [True, False])
def test_large_pages_take_time_in_proportion(spark, marked):
    def page(n):
        each = "<div class='review-item' id='r{0}'><span>u{0}</span><i aria-label='4 stars'></i><p class='review-content'>text number {0} with words</p><b>1</b></div>"
        plain = "<section><div><span>u***{0}</span> <time>2024-01-11 10:10</time></div><p>text number {0} with some words</p><b>1</b></section>"
        return "<body>" + "".join((each if marked else plain).format(i) for i in range(n)) + "</body>"

    def took(n):
        df = spark.createDataFrame([(1, page(n))], "page_id long, html string")
        nodes = pages.page_nodes(df).cache()
        size = nodes.select(F.size("nodes")).first()[0]
        rows = pages.page_reviews(nodes, "shopee")
        began = time.time()
        assert rows.where("length(text) > 0").count() == n
        return time.time() - began, size

    took(5)  # compiles
    (small, a), (large, b) = took(100), took(500)
    assert b > 5000 and large < 30 and large < 2.5 * b / a * max(small, 1.0)
