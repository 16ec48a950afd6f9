import duckdb

from foliant.plans import queries_text
from foliant.sources.files import html_to_markdown

HEADS = ["a &amp; b &lt;c&gt;", "cut &&&amp", "cut token = &quot;73ab", "&amp;lt; &amp;amp; &copy; &#65; &", "&lt &gt &nbsp;x", "plain"]


def test_references_that_are_cut_equal_the_sql(spark, tmp_path):
    pages = [(i, f"<html><body><h1>{h}</h1><p><a href='?a=1&amp;b=2&copy=3'>x</a></p></body></html>") for i, h in enumerate(HEADS)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries_text.html_outline(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(db.execute(queries_text.HTML_OUTLINE).fetchall())
    assert got[1][1:] == ("cut &&&amp", 1, 1)


def test_references_by_default_are_those_of_html():
    assert html_to_markdown("<h1>&quot;a&quot; &amp b &copy;</h1>") == '# "a" & b ©'
    assert html_to_markdown("<a href='?a&amp;b&copy=1'>&quot;</a>", references=("amp",)) == "[&quot;](?a&b&copy=1)"
