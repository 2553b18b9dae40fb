"""What the fourth round of findings named: queries on blank and odd texts, which the smallest tables don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from reviewspark import catalog
from reviewspark.functions import text as T
from reviewspark.sources import reviews as S

BLANK = (None, "", " ", "   ")
#: Texts without a piece, and texts that engines cut differently: white space, adjacent connectors, letters beyond ASCII, long lists.
HOLLOW = (*BLANK, "\n", "\n \n", "\u00a0", "\u2003 \n\u1680", "\u0001")
ODD = (
    "The lid fits. It leaks; ok", "\t", "\v", "\r\n", "a.\v b \v; c", "It\u00a0leaks \u00a0; now", "\u2003a.\u2003 b\u1680 ; \u202fc but\u3000because d", "fine but because it fails", "fine but  because it fails", "a but but but b",
    "but, because. but; yet but", "it but\u00f6 fails yet\u00f1", "e\u0301 but\u0301 x", "it \u212aaso fails", "it \u017fince fails", "it but\u017f yet\u212a x", "\v".join(f"w{i}," for i in range(25)), " ".join(f"w{i}," for i in range(21)),
)


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query over texts, and those of its SQL."""

    def run(name, texts, first=1):
        d = tmp_path / f"{name}-{first}"
        spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(first, 1, 0), (first + 1, 0, 1)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
        want = con.execute(catalog.SQL[name])
        columns = [c[0] for c in want.description]
        got = catalog.QUERIES[name](spark, str(d)).select(*columns).collect()
        return sorted(repr(tuple(r)) for r in got), sorted(map(repr, want.fetchall()))

    return run


def test_file_of_reviews_with_texts_blank_before(against_sql):
    """Every fifth text has words; ids 1 to 60, so that one of 41 is blanked, and one of 31 and of 37 is wrong otherwise."""
    got, want = against_sql("csv_reviews", [t for i in range(12) for t in (*BLANK, f"The lid {i} fits")])
    assert got == want and len(got) == 60
    assert [r for r in got if "blank_text" in r] == ["('review_41', 'p1', 2, 2, 'blank_text')"]


def test_reader_charges_every_blank_text(spark, tmp_path):
    """What the query leaves out stands in the reader's own charges."""
    row = lambda i, t: (f"r{i}", "p", "title", t, "", "5", "authentic", "0")
    spark.createDataFrame([row(i, t) for i, t in enumerate((*BLANK, "words"))], [*S.REQUIRED]).write.option("header", True).option("quoteAll", True).csv(f"{tmp_path}/csv")
    assert {r.review_id: r.problems for r in S.read_reviews(spark, f"{tmp_path}/csv").collect()} == {**{f"r{i}": ["blank_text"] for i in range(4)}, "r4": []}


def test_segments_of_odd_texts(against_sql):
    """Reviews without a piece have no row; others have as many pieces as the SQL cuts."""
    got, want = against_sql("evidence_segments", HOLLOW + ODD)
    assert got == want and len(got) == len(ODD)


def test_evidence_of_odd_texts(against_sql):
    """Reviews without a piece have no evidence, in either of two places of their ids."""
    got, want = against_sql("evidence_selected", 2 * (HOLLOW + ODD))
    assert got == want and len(got) > len(ODD)


def test_segments_of_the_library(spark):
    """Read as the reference reads: connectors that follow each other each begin a clause; a blank text is one empty piece."""
    texts = ["fine but because it fails", "\n \n", " \u00a0", "it but\u00f6 x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.evidence_segments(F.col("t")).alias("s")).collect()
    assert [r.s for r in sorted(got)] == [["fine", "but", "because it fails"], [""], [""], ["it but\u00f6 x"]]
