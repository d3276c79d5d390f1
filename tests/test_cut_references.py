"""Pages cut inside a character reference: what their SQL says."""

import pytest
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

from sitegrain.operators import fields, page_tree
from sitegrain.plans import ORACLES, QUERIES
from sitegrain.plans.landed import TABLES


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """The smallest tables with the ends of titles, headings and paragraphs cut as in the larger ones."""
    d = tmp_path_factory.mktemp("cut")
    for name in TABLES:
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name == "pages":
            end = F.element_at(F.array(*map(F.lit, ["&amp", "&am", "&lt", "&copy", "&#x27", "&amp;amp", "&", " &ltx;", "&amp;"])), (F.col("page_id") % 9 + 1).cast("int"))
            for tag in ("title", "h1", "p"):
                rows = rows.withColumn("html", F.replace("html", F.lit(f"</{tag}>"), F.concat(end, F.lit(f"</{tag}>"))))
        rows.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    for folder in d.iterdir():
        part = next(folder.glob("*.parquet"))
        part.rename(d / "part")
        for left in folder.iterdir():
            left.unlink()
        folder.rmdir()
        (d / "part").rename(folder)
    return str(d)


@pytest.mark.parametrize("name", ["ordered_checks", "page_audit", "page_audit_facts", "page_checks", "page_scores", "page_checks_of_every_kind", "page_scores_all_checks",
                                  "page_text", "page_title_h1", "title_lengths", "result_titles"])
def test_cut_references_match_sql(spark, cut, name):
    ok, note = compare(spark, connect(cut), cut, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_references_with_and_without_an_end(spark):
    assert page_tree.ended_only("a&amp&amp;&lt b&notit;&#65;&#65 &#x41;&#xg;&") == "a&amp;amp&amp;&amp;lt b&amp;notit;&#65;&amp;#65 &#x41;&amp;#xg;&amp;"
    page = '<title>a&amp</title><meta name=description content="x&lt"><body>b&copy<script>var a="&amp"</script>'
    rows = spark.createDataFrame([("https://e.com/", page)], "url string, html string")
    wanted = ["title", "meta_description", "all_text", "inline_script_bytes"]
    assert tuple(fields.extract(rows, wanted).first())[1:] == ("a&", "x<", "b©", 12)
    assert tuple(fields.extract(rows, wanted, ended=True).first())[1:] == ("a&amp", "x&lt", "b&copy", 12)


def test_titles_cut_in_a_reference_are_no_duplicates(spark, tmp_path):
    pages = [(1, "a &amp;"), (2, "a &amp"), (3, "a &amp;"), (4, "b &am"), (5, "b &am"), (6, "c &amp"), (7, "c &amp"), (8, "c &")]
    rows = [(i, f"https://e.com/{i}", f"<html><head><title>{t}</title></head></html>") for i, t in pages]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["duplicate_titles"](spark, str(tmp_path)).collect()
    assert sorted((r.title, r.pages) for r in found) == [("a &", 2), ("b &am", 2), ("c &amp", 2)]
