"""The audit of a small site from its pages' own HTML, and that its link rules read the edge table without a shuffle."""

from pyspark.sql import functions as F

from sitegrain.operators import audit, crawl
from sitegrain.session import bucketed, forget

B = "https://e.com"
FULL = '<html lang=en><head><title>{t}</title><meta name=description content="{d}"><meta name=viewport content=x><link rel=canonical href="{u}"><meta property=og:title content=T><meta property=og:image content=i>'
GOOD = FULL + '<script type="application/ld+json">{{"@type":"A"}}</script></head><body><h1>{t}</h1><p>{w}</p>{rest}'
WORDS = " ".join(f"word{i}" for i in range(220))


def page(path, rest="", title=None, **more):
    html = GOOD.format(t=title or f"A title of the page {path} that is long enough", d=f"Description of {path} " + "x" * 70, u=B + path, w=f"{path} {WORDS}", rest=rest)
    return {"url": B + path, "html": html, "status": 200, "ttfb_ms": 10, "compressed": True, "depth": 1} | more


def landed(spark):
    rows = [
        page("/", '<nav><a href="/a">a</a><a href="/b#x">b</a><a href=/a>again</a></nav><a href="/gone">g</a><a href="/moved">m</a><a href="https://x.org/dead">d</a><img src="/ok.png" alt="ok"><img src="/no.png" alt="no">', depth=0),
        page("/a", '<a href="/">home</a><a href="http://e.com/b" rel=nofollow>b</a><a href="/f">f</a><img src="http://cdn.e.org/i.png">', depth=1),
        page("/b", '<a href="/a">a</a><a href="https://x.org/dead">d</a>', depth=4, title="Short"),
        page("/gone", "", status=404), page("/moved", "", status=301, redirect_to=B + "/a"), page("/orphan", '<a href="/">h</a>'),
        page("/f", "<a href='/a'>a</a>") | {"html": "<title></title><p>few words"},
    ]
    schema = "url string, html string, status int, ttfb_ms int, compressed boolean, depth int, redirect_to string"
    responses = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)
    sitemap = spark.createDataFrame([("e.com", B + p) for p in ("/", "/orphan", "/gone")], "site string, loc string")
    checks = spark.createDataFrame([("e.com", B + "/ok.png", 200, None), ("e.com", B + "/no.png", 404, None), ("e.com", "https://x.org/dead", 404, None)], "site string, url string, status int, code string")
    sites = spark.createDataFrame([("e.com", B + "/", "redirects", "n/a", None, None, True, True, False)], "site string, final_url string, https_redirect string, host_canonicalization string, http_url string, alternate_host_url string, robots_found boolean, sitemap_found boolean, limit_reached boolean")
    return responses, sitemap, checks, sites


def test_findings_from_html(spark):
    responses, sitemap, checks, sites = landed(spark)
    found = crawl.landed_crawl(responses, sitemap, 4)
    got = {}
    for r in crawl.findings(found, checks, sites).collect():
        got.setdefault(r["issue"], {})[r["url"].removeprefix(B)] = r["detail"]
    assert got["broken-internal-links"] == {"/": f"1 broken: {B}/gone (404)"} and got["links-to-redirect"] == {"/": f"1 link(s), e.g. {B}/moved"}
    assert got["broken-images"] == {"/": f"1 broken: {B}/no.png"} and set(got["broken-external-links"]) == {"/", "/b"}
    assert set(got["missing-title"]) == set(got["missing-description"]) == set(got["missing-h1"]) == set(got["missing-lang"]) == set(got["dead-end"]) == set(got["low-word-count"]) == {"/f"}
    assert set(got["orphan-page"]) == {"/orphan"} and set(got["page-4xx"]) == set(got["sitemap-non-200"]) == {"/gone"} and got["page-4xx"]["/gone"].startswith("HTTP 404 · linked from 1 ")
    assert set(got["nofollow-internal"]) == set(got["http-internal-links"]) == set(got["missing-alt"]) == set(got["mixed-content"]) == {"/a"}
    assert set(got["deep-page"]) == {"/b"} and got["title-too-short"] == {"/b": "5 chars: “Short”"} and "duplicate-content" not in got
    counts = {r["url"].removeprefix(B): (r["inlinks"], r["internal_links"], r["external_links"], r["in_sitemap"]) for r in found.pages.collect()}
    assert counts["/"] == (2, 4, 1, True) and counts["/a"] == (2, 3, 0, False) and counts["/b"] == (1, 1, 1, False) and counts["/orphan"] == (0, 1, 0, True)
    assert audit.health_score(found.pages, crawl.findings(found, checks, sites)).first()["health_score"] == 43


def test_edges_meet_pages_and_inlinks_without_a_shuffle(spark):
    responses, sitemap, *_ = landed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = crawl.landed_crawl(responses, sitemap, 4)
        targets = found.pages.select("site", F.col("url").alias("dst"), "status")
        for plan in (found.internal.join(targets, ["site", "dst"]), audit.inlink_counts(found.internal), audit.distinct_edges(found.internal)):
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_addresses_and_html_are_needed(spark):
    found = crawl.landed_crawl(spark.createDataFrame([("https://e.com/#f", None), ("https://e.com/x", "<a href=/>h</a>")], "url string, html string"), spark.createDataFrame([], "site string, loc string"), 2)
    assert sorted((r["url"], r["inlinks"], r["status"], r["word_count"]) for r in found.pages.collect()) == [("https://e.com/", 1, 200, 0), ("https://e.com/x", 0, 200, 1)]


def test_bucketed_tables_are_dropped(spark):
    table = bucketed(spark.range(10).selectExpr("id", "id % 3 AS k"), "k", buckets=3)
    assert table.groupBy("k").count().count() == 3
    name = table.settled_name
    forget(table)
    assert not spark.catalog.tableExists(name)
