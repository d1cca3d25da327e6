"""Queries of the library against their SQL, and literal cases of its functions."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslake import catalog
from corpuslake.functions import text as T
from corpuslake.functions.unicode import visible_text

SF = "/root/testdata/sf0.001"


def rows(found):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    want = c.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want.select(",".join(columns)).fetchall())


def test_language_thresholds(spark):
    texts = [("привет world", "ru"), ("hello", "en"), ("123", "other"), ("aaaaaaa я", "en"), ("aaaaa яя", "ru")]
    got = spark.createDataFrame(texts, "t string, want string").select("want", T.language(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == ["ru", "en", "other", "en", "ru"]


def test_ngrams_need_enough_words(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "w array<string>").select(T.ngrams(F.col("w"), 2).alias("g"))
    assert [r.g for r in df.collect()] == [["a b", "b c"], []]


def test_visible_text():
    assert visible_text("<p>a</p><script>x</script>b &amp;lt;") == "\na\nb <"
    assert visible_text(None) is None


def test_html_text_of_cut_references(spark, tmp_path):
    """Titles are cut at a length, also within a reference; SQL resolves those with their semicolon."""
    pages = ["<h1>a&amp;b &amp</h1>c", "<p>&am</p>&copy 1 &copy; &quo", "<p>&amp;amp; &amp;amp &ampx; &amp;quot</p>", "<a href='?a=1&copy=2'>x</a>&quot;&middot;", "<p>a &amp;&amp;&amp</p>"]
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["html_text"](spark, str(tmp_path)).select("page_id", "text").collect()
    assert rows(tuple(r) for r in got) == rows(c.sql(catalog.ORACLES["html_text"]).fetchall())
    assert visible_text("<p>a&amp</p>") == "\na&\n"
