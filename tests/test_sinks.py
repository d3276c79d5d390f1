import csv
import glob
import json

from pyspark.sql import functions as F

from sitegrain.operators import domains, posts
from sitegrain.sources import sinks
from sitegrain.sources import responses


def test_csv_round_trip_and_formula_guard(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=SUM(A1)", ["a", "b"], None), (2, 'say "hi", ok', [], "x\ny"), (3, "@me", ["-"], "-1")], "id int, t string, tags array<string>, n string")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "out"))
    with open(glob.glob(str(tmp_path / "out" / "*.csv"))[0], newline="", encoding="utf8") as f:
        got = {r["id"]: r for r in csv.DictReader(f)}
    assert got["1"]["t"] == "'=SUM(A1)" and got["1"]["tags"] == "a; b" and got["1"]["n"] == ""
    assert got["2"]["t"] == 'say "hi", ok' and got["2"]["n"] == "x\ny" and got["3"]["n"] == "'-1" and got["3"]["tags"] == "'-"


def test_json_lines_and_whole_reports(spark, tmp_path):
    rows = spark.createDataFrame([("e", 5)], "site string, n int")
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert spark.read.schema("site string, n int").json(str(tmp_path / "j")).first()["n"] == 5
    assert json.loads(sinks.report_documents(rows).first()["value"]) == {"site": "e", "n": 5}


def test_exports_have_the_columns_of_the_reports(spark):
    page = spark.range(1).select(*[F.lit("v").alias(c) for c in ("url", "status", "redirect_to", "depth", "inlinks", "title", "meta_description", "h1", "word_count", "ttfb_ms", "html_bytes", "canonical", "noindex", "in_sitemap")],
                                 F.array(F.lit("a"), F.lit("b")).alias("issues"))
    out = sinks.pages_export(page)
    assert len(out.columns) == 15 and out.first()["issues"] == "a b"
    ext = spark.range(1).select(F.lit("u").alias("url"), F.lit(404).alias("status"), F.lit(None).cast("string").alias("error"), F.array(F.lit("s")).alias("sources"))
    assert sinks.externals_export(ext).first().asDict() == {"url": "u", "status": 404, "error": "", "linked_from": "s"}
    link = spark.range(1).select(F.lit("u").alias("href"), F.lit("t").alias("text"), F.lit(True).alias("internal"), F.array(F.lit("nofollow")).alias("rel"), F.lit(2).alias("count"), F.lit(200).alias("status"))
    assert sinks.links_export(link).columns == ["url", "anchor", "internal", "rel", "count", "status"]


def test_sections_and_posts(spark, tmp_path):
    assert domains.wanted_sections("dns,keywords,zzz") == ["homepage", "crawlability", "keywords", "dns"]
    assert domains.wanted_sections("") == domains.SECTIONS
    (tmp_path / "2026-01-02-a-post.md").write_text("---\ntitle: 'Hi'\ntags:\n  - x\n  - y\ndate: 2026-01-02T00:00:00Z\n---\n## Part\n" + "word " * 500)
    (tmp_path / "notes.md").write_text("no")
    row = posts.parse_posts(responses.read_posts(spark, str(tmp_path))).first()
    assert (row["slug"], row["title"], row["tags"], row["words"], row["reading_minutes"]) == ("a-post", "Hi", ["x", "y"], 501, 2)
    full = spark.createDataFrame([("f", "page", "T", "d" * 60, "2026-01-02T00:00:00Z", "2026-01-02-page.md", None, ["x"],
                                   [("p", "t", "https://a.com/1"), ("p", "t", "https://www.a.com/2")], [("one", [1, 2]), ("", [9]), ("three", [1])], ("m", "k", "12", None, "x" * 30), "# top\n<b>seamless</b>")],
                                 "k string, slug string, title string, description string, date string, file string, updated string, tags array<string>, sources array<struct<publisher:string,title:string,url:string>>,"
                                 " key_facts array<struct<text:string,sources:array<int>>>, cover struct<motif:string,kicker:string,stat:string,stat_label:string,alt:string>, markdown string")
    found = set(full.select(posts.document_problems(full).alias("p")).first()["p"])
    assert found == {"reserved-slug", "source-hosts", "fact-text", "fact-source", "fact-hosts", "words", "top-heading", "no-section", "raw-html", "banned:seamless"}
    assert full.select(posts.tag_overlap(F.array(F.lit("x"), F.lit("y")), F.col("tags")).alias("o")).first()["o"] == ["x"]
