"""Queries of what pages and panels show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions import contract as C
from reviewspark.functions import panel as P
from reviewspark.operators import panels, views
from reviewspark.plans import relation as R
from reviewspark.queries import on_reviews, query


def picked(values: tuple[str, ...]):  # noqa: ANN201
    """A value of a list by the id, in Spark."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def sql_picked(values: tuple[str, ...]) -> str:
    """The same in SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][doc_id % {len(values)} + 1]"


_URLS = ("https://shopee.ph/x-i.12.34", "http://m.shopee.ph/product/12/34", "https://shopee.ph/cart", "https://www.lazada.com.ph/products/a-b-i77-s8.html", "https://lazada.com.ph/shop", "https://notshopee.ph/product/1", "ftp://shopee.ph/product/1", "http://localhost/x", "http://192.168.0.7:80/p", "https://user@host.com/a", "'https://img.ph/a.jpg' ", "")


@on_reviews(
    "url_predicates",
    rf"""SELECT review_id, u AS url, CASE WHEN regexp_matches(h, '(?i)(^|\.)shopee\.ph$') AND regexp_matches(p, '(?i)(-i\.|/product/|/product\.)\d+') THEN 'shopee' WHEN regexp_matches(h, '(?i)(^|\.)lazada\.com\.ph$') AND regexp_matches(p, '(?i)/products/.+-i\d+') THEN 'lazada' END AS market,
    s <> '' AND NOT regexp_matches(s, '^(localhost|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)|\.local$') AS safe, CASE WHEN regexp_matches(w, '(?i)^https?://[^/\s?#]+') THEN w END AS web
    FROM (SELECT *, regexp_extract(u, '(?i)^https?://([^/?#:]+)', 1) AS h, regexp_extract(u, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS p, lower(regexp_extract(u, '(?i)^https?://([^/?#:@\s]+)(:\d+)?([/?#]|$)', 1)) AS s, regexp_replace(trim(u), '^[''"]|[''"]$', '', 'g') AS w FROM (SELECT review_id, {sql_picked(_URLS)} AS u FROM reviews))""",
)
def url_predicates(r: DataFrame) -> DataFrame:
    u = F.col("url")
    return r.select("review_id", picked(_URLS).alias("url")).withColumns({"market": P.product_page(u), "safe": P.safe_url(u), "web": P.web_url(u)})


_RATED = ("rated 4 stars today", "4.5 out of 5", "3/5", "5 star", "stars", "6 stars", "1 / 5 only", "12 stars", "no number", "10 out of 5")


@on_reviews(
    "ratings_in_text",
    rf"""SELECT review_id, CASE WHEN m <> '' THEN m::DOUBLE END AS rating, CASE WHEN w <> '' THEN greatest(1, least(5, floor(w::INT / 20 + 0.5)))::INT END AS stars FROM (
    SELECT review_id, regexp_extract({sql_picked(_RATED)}, '(?i)(?:^|\s)([1-5](?:\.\d)?)\s*(?:out of 5|stars?|/\s*5)(?:\s|$)', 1) AS m, regexp_extract(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'color:red; width: ' || doc_id % 130 || '%' END, '(?i)width\s*:\s*(\d{{1,3}})%', 1) AS w FROM reviews)""",
)
def ratings_in_text(r: DataFrame) -> DataFrame:
    style = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("color:red; width: "), (F.col("doc_id") % 130).cast("string"), F.lit("%")))
    return r.select("review_id", P.rating_in_text(picked(_RATED)).alias("rating"), P.rating_of_width(style).alias("stars"))


_CARDS = ("j***n\n2024-05-01 10:22 | Variation: red\nMahusay  ang tela\nHelpful 3", "Variation: blue\n12\n0:15 0:20\nGood  sound\n2023/1/2", "s**a 2024-01-02\nReport\nText stays\nlike 9 times", "Seller Reply: thank you", "reply from seller\nok", "tugon ng tindahan", "1999-01-01\nold date stays")


@on_reviews(
    "card_texts",
    rf"""SELECT review_id, coalesce(string_agg(l, ' ' ORDER BY i) FILTER (NOT (regexp_matches(l, '^[0-9A-Za-z_.*-]*\*{{2,}}[0-9A-Za-z_.*-]*$') OR regexp_matches(l, '^[0-9A-Za-z_.*-]*\*{{2,}}[0-9A-Za-z_.*-]*\s*20\d{{2}}[-/.]') OR regexp_matches(l, '^20\d{{2}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(\s+\d{{1,2}}:\d{{2}})?(\s*\|.*)?$')
      OR regexp_matches(l, '(?i)^(variation|variant)\s*:') OR regexp_matches(l, '^(\d{{1,2}}:\d{{2}}\s*)+$') OR regexp_matches(l, '(?i)^(helpful|report|like|reply)(\s*\d+)?$') OR regexp_matches(l, '^\d+$'))), '') AS text, any_value(dated) AS dated, any_value(reply) AS reply
    FROM (SELECT review_id, dated, reply, unnest(q) AS raw, trim(regexp_replace(unnest(q), '\s+', ' ', 'g')) AS l, unnest(range(len(q))) AS i FROM (SELECT review_id, regexp_split_to_array(c, '\n+') AS q, regexp_matches(c, '\b20\d{{2}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(\s+\d{{1,2}}:\d{{2}})?\b') AS dated,
      regexp_matches(trim(c), '(?i)^(seller|shop|merchant)\s*(reply|response)|^(reply|response)\s+from\s+(seller|shop)|^(tugon|sagot)\s+(ng|mula sa)\s+(seller|shop|tindahan)') AS reply FROM (SELECT review_id, replace({sql_picked(tuple(c.replace(chr(10), "@@") for c in _CARDS))}, '@@', chr(10)) AS c FROM reviews))) WHERE l <> '' GROUP BY 1""",
)
def card_texts(r: DataFrame) -> DataFrame:
    c = F.col("c")
    return r.select("review_id", picked(_CARDS).alias("c")).select("review_id", P.body_text(c).alias("text"), P.has_review_date(c).alias("dated"), P.seller_reply(c).alias("reply"))


@on_reviews(
    "panel_numbers",
    """SELECT product_id, n, CASE WHEN n = 0 THEN 0 ELSE floor(a / n * 100 + 0.5) END::INT AS percent, CASE WHEN n = 0 THEN 'No eligible reviews' WHEN floor(100 * a / n + 0.5) >= 75 THEN 'Mostly authentic reviews' WHEN floor(100 * a / n + 0.5) >= 50 THEN 'Mixed review quality' ELSE 'Few authentic reviews' END AS band,
    CASE WHEN a / n <= 0.9 THEN printf('%.2f%%', a / n * 100) ELSE 'Not evaluated' END AS shown FROM (SELECT product_id, count(*) AS n, count(*) FILTER (pred = 0) AS a FROM reviews GROUP BY 1)""",
)
def panel_numbers(r: DataFrame) -> DataFrame:
    g = r.groupBy("product_id").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 0).alias("a"))
    share = F.col("a") / F.col("n")
    return g.select("product_id", "n", P.percent(F.col("a"), F.col("n")).alias("percent"), P.status_band(F.col("n"), share * 100).alias("band"), P.metric_score(F.when(share <= 0.9, share)).alias("shown"))


@on_reviews(
    "extraction_signature",
    "SELECT product_id, sha256(string_agg(concat_ws(chr(31), review_id, '', trim(review_text), CASE WHEN doc_id % 6 = 0 THEN '' ELSE star_rating::VARCHAR END, 'i' || doc_id), chr(30) ORDER BY doc_id)) AS signature FROM reviews GROUP BY 1",
)
def extraction_signature(r: DataFrame) -> DataFrame:
    """What changes when a page's reviews do; a page holds few reviews, so a row holds its signature."""
    star = F.when(F.col("doc_id") % 6 == 0, F.lit(None)).otherwise(F.col("star_rating"))
    each = P.signature([F.col("review_id"), F.lit(""), F.trim("review_text"), star, F.concat(F.lit("i"), F.col("doc_id").cast("string"))])
    return r.select("product_id", "doc_id", each.alias("s")).groupBy("product_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]), "\u001e"), 256).alias("signature"))


@on_reviews(
    "extraction_rows",
    """SELECT review_id, t <> '' AND s IS NOT NULL AND s = floor(s) AND s BETWEEN 1 AND 5 AS eligible, array_to_string(list_filter([CASE WHEN t = '' THEN 'text' END, CASE WHEN s IS NULL THEN 'rating' END, CASE WHEN doc_id % 4 <> 1 THEN 'image' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM (SELECT review_id, doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE trim(review_text) END AS t, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 4.5 ELSE star_rating END::DOUBLE AS s FROM reviews)""",
)
def extraction_rows(r: DataFrame) -> DataFrame:
    return panels.extraction_rows(loaded(r)).select("review_id", "eligible", F.array_join("missing", ",").alias("missing"))


def loaded(r: DataFrame) -> DataFrame:
    """Reviews as a page shows them: some without text, rating or image."""
    d = F.col("doc_id")
    return r.select("doc_id", "review_id", "product_id", F.when(d % 11 == 0, "").otherwise(F.trim("review_text")).alias("text"), F.when(d % 7 == 0, F.lit(None)).when(d % 13 == 0, 4.5).otherwise(F.col("star_rating")).cast("double").alias("rating"), F.when(d % 4 == 1, F.array(F.concat(F.lit("https://img/"), d.cast("string")))).otherwise(F.array().cast("array<string>")).alias("urls"))


_LOADED = """, ld AS (SELECT doc_id, review_id, product_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE trim(review_text) END AS t, (CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 4.5 ELSE star_rating END)::DOUBLE AS s, doc_id % 4 = 1 AS im FROM reviews)"""


@on_reviews(
    "extraction_stats",
    _LOADED
    + """, u AS (SELECT *, CASE WHEN t = '' THEN 1 ELSE row_number() OVER (PARTITION BY product_id, lower(t) ORDER BY doc_id) END AS again FROM ld WHERE t <> '' OR s IS NOT NULL OR im), k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY doc_id) AS place FROM u WHERE again = 1)
    SELECT product_id, (SELECT count(*) FROM ld x WHERE x.product_id = p.product_id) AS candidates, (SELECT count(*) FROM k WHERE k.product_id = p.product_id AND place <= 4) AS accepted, (SELECT count(*) FROM k WHERE k.product_id = p.product_id AND place <= 4 AND t <> '' AND s = floor(s) AND s BETWEEN 1 AND 5) AS analyzable,
    (SELECT count(*) FROM u WHERE u.product_id = p.product_id AND again > 1) AS duplicates, (SELECT count(*) FROM u WHERE u.product_id = p.product_id AND t = '') AS without_text, (SELECT count(*) FROM k WHERE k.product_id = p.product_id AND place <= 4 AND im) AS with_images, (SELECT count(*) FROM k WHERE k.product_id = p.product_id AND place <= 4 AND s IS NOT NULL) AS with_ratings
    FROM (SELECT DISTINCT product_id FROM ld) p""",
)
def extraction_stats(r: DataFrame) -> DataFrame:
    """Counters of each page; here a page accepts four reviews."""
    return panels.extraction_stats(loaded(r).withColumnRenamed("doc_id", "pos"), "product_id", most=4)


@on_reviews(
    "scan_coverage",
    _LOADED
    + """ SELECT product_id, count(*) AS loaded, count(*) FILTER (e) AS analyzed, count(*) FILTER (NOT e) AS skipped, count(*) FILTER (NOT e AND t = '') AS missing_text, count(*) FILTER (NOT e AND NOT v) AS missing_rating, count(*) FILTER (t <> '') AS with_text, count(*) FILTER (v) AS with_rating, count(*) FILTER (im) AS with_photos
    FROM (SELECT *, coalesce(s = floor(s) AND s BETWEEN 1 AND 5, false) AS v, t <> '' AND coalesce(s = floor(s) AND s BETWEEN 1 AND 5, false) AS e FROM ld) GROUP BY 1""",
)
def scan_coverage(r: DataFrame) -> DataFrame:
    return panels.scan_coverage(loaded(r), "product_id")


_TIMES = "SELECT user_id, max(ts) AS last FROM events GROUP BY 1"


@query("freshness", f"SELECT user_id, greatest(0, floor((epoch_us(now) - epoch_us(last)) / 60000000))::BIGINT AS minutes FROM ({_TIMES}) CROSS JOIN (SELECT max(ts) AS now FROM events)", False)
def freshness(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    now = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).select("user_id", P.minutes_since(F.col("last"), F.col("now")).alias("minutes"))


@query("vector_math", """SELECT vec_id, round(list_sum(list_transform(list_zip(u, m), lambda x: x[1] * x[2])), 6) AS near_mean, round(list_max(s), 6) AS soft, round(list_sum(g) / len(g), 6) AS sig FROM (
    SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u, list_transform(range(1, len(v) + 1), lambda i: (v[i] + v[len(v) + 1 - i]) / 2) AS m, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS s, list_transform(v, lambda x: 1 / (1 + exp(-x))) AS g FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""", False)
def vector_math(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors against the mean of the vector and its reverse, the greatest softmax share and the mean sigmoid."""
    v = F.col("embedding").cast("array<double>")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", v.alias("v"))
    m = P.mean_vector(F.array("v", F.reverse("v")))
    g = P.sigmoid(F.col("v"))
    return e.select("vec_id", F.round(P.dot(P.unit(F.col("v")), m), 6).alias("near_mean"), F.round(F.array_max(P.softmax(F.col("v"))), 6).alias("soft"), F.round(F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g), 6).alias("sig"))


@on_reviews("verdict_titles", "SELECT review_id, CASE l WHEN 'authentic' THEN 'Authentic' WHEN 'deceptive' THEN 'Deceptive' WHEN 'liv' THEN 'Low-value' WHEN 'irrelevant' THEN 'Irrelevant' WHEN 'unavailable' THEN 'Not analyzed' ELSE l END AS title FROM (SELECT review_id, ['authentic', 'deceptive', 'liv', 'irrelevant', 'unavailable', 'else'][doc_id % 6 + 1] AS l FROM reviews)")
def verdict_titles(r: DataFrame) -> DataFrame:
    return r.select("review_id", P.verdict_title(picked(("authentic", "deceptive", "liv", "irrelevant", "unavailable", "else"))).alias("title"))


@on_reviews("input_parts", """SELECT review_id, CASE WHEN doc_id % 2 = 0 THEN 'r ' || doc_id ELSE 'plain ' || doc_id END AS review, CASE WHEN doc_id % 2 = 0 THEN 't ' || doc_id % 7 ELSE '' END AS title, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'd x' ELSE '' END AS description FROM reviews""")
def input_parts(r: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    made = C.quality_input_text(F.concat(F.lit("r  "), d.cast("string")), F.concat(F.lit(" t "), (d % 7).cast("string")), F.when(d % 3 == 0, "d \n x"))
    text = F.when(d % 2 == 0, made).otherwise(F.concat(F.lit("plain "), d.cast("string")))
    return r.select("review_id", C.quality_input_parts(text).alias("p")).select("review_id", "p.*")


@on_reviews("input_pairs", r"""SELECT review_id, array_to_string(w[1:(m - 4 - k - least(len(x), c - k))], ' ') AS review, array_to_string(list_concat(t[1:k], x[1:(c - k)]), ' ') AS context FROM (
    SELECT *, least(len(t), 10, greatest(1, c * 10 // 28))::INT AS k FROM (
    SELECT review_id, string_split(trim(regexp_replace(review_text, '\s+', ' ', 'g')), ' ') AS w, ['Item', 'number', (doc_id % 9)::VARCHAR] AS t, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [x::VARCHAR for x in range(doc_id % 40)] END AS x, m, least(28, greatest(2, (m - 4) // 4), m - 5)::INT AS c FROM (SELECT *, (12 + doc_id % 90)::INT AS m FROM reviews)))""")
def input_pairs(r: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    title = F.concat(F.lit("Item number "), (d % 9).cast("string"))
    words = F.when(d % 5 == 0, "").otherwise(F.array_join(F.transform(F.when(d % 40 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), d % 40 - 1)), lambda x: x.cast("string")), " "))
    return r.select("review_id", C.quality_input_pair(F.col("review_text"), title, words, (12 + d % 90).cast("int")).alias("p")).select("review_id", "p.*")


@on_reviews("aspect_prompts", f"SELECT DISTINCT aspect, ({[f'{a}: {d}' for a, d in C.DEFINITIONS.items()]!r})[aspect + 1] AS prompt FROM gold")
def aspect_prompts(r: DataFrame) -> DataFrame:
    names = C.aspects(r.sparkSession)
    return R.gold_pairs(r).select("aspect").distinct().join(names, "aspect").select("aspect", C.aspect_prompt(F.col("category")).alias("prompt"))


@on_reviews("review_page", "SELECT review_id, place, total FROM (SELECT review_id, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS total FROM reviews WHERE pred = 0) WHERE place > 20 AND place <= 40")
def review_page(r: DataFrame) -> DataFrame:
    own = r.where("pred = 0")
    total = own.agg(F.count("*").alias("total"))
    return views.page(own, "original", 1).crossJoin(F.broadcast(total)).select("review_id", F.col("place").cast("bigint").alias("place"), "total")


@on_reviews("top_aspects", "SELECT aspect, mentions, positive_percent FROM (SELECT aspect, count(*) AS mentions, floor(100.0 * count(*) FILTER (sentiment = 2) / count(*) + 0.5)::INT AS positive_percent FROM predicted p JOIN reviews r USING (review_id) WHERE r.pred = 0 GROUP BY 1) ORDER BY mentions DESC, aspect LIMIT 5")
def top_aspects(r: DataFrame) -> DataFrame:
    hit = R.predicted_pairs(r).join(r.where("pred = 0").select("review_id"), "review_id", "left_semi").groupBy("aspect").agg(F.count("*").alias("mentions"), F.count_if(F.col("sentiment") == 2).alias("positive"))
    return hit.select("aspect", "mentions", P.percent(F.col("positive"), F.col("mentions")).alias("positive_percent")).orderBy(F.desc("mentions"), "aspect").limit(5)
