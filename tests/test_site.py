"""The small site of the audit: depths, chains, issues, statistics, and the skewed forms against brute force."""

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import audit, graph, ranking, robots
from sitegrain.sources import responses

B = "https://e.com"
PAGES = [  # url, status, redirect, in_sitemap, noindex
    ("/", 200, None, True, False), ("/about", 200, None, True, False), ("/blog", 200, None, False, False), ("/blog/post-1", 200, None, False, False), ("/broken", 404, None, False, False),
    ("/old", 301, "/about", True, False), ("/chain1", 301, "/chain2", False, False), ("/chain2", 302, "/about", False, False), ("/private/secret", -1, None, False, False), ("/error", 500, None, False, False),
    ("/deep/1", 200, None, False, False), ("/deep/2", 200, None, False, False), ("/deep/3", 200, None, True, True), ("/orphan", 200, None, True, False),
]
LINKS = [("/", t) for t in ("/about", "/blog", "/broken", "/old", "/chain1", "/private/secret", "/error", "/")] + [
    ("/blog", "/blog/post-1"), ("/blog/post-1", "/deep/1"), ("/deep/1", "/deep/2"), ("/deep/2", "/deep/3"), ("/about", "/")]


@pytest.fixture(scope="module")
def site(spark):
    pages = spark.createDataFrame([("e", B + u, s, None if r is None else B + r, m, n, i) for i, (u, s, r, m, n) in enumerate(PAGES)],
                                  "site string, url string, status int, redirect_to string, in_sitemap boolean, noindex boolean, ord int")
    links = spark.createDataFrame([("e", B + a, B + b, i) for i, (a, b) in enumerate(LINKS)], "site string, src string, dst string, ord int")
    return pages, links


@pytest.mark.parametrize("rows_per_part", [1_000_000, 2])
def test_click_depths(spark, site, rows_per_part):
    pages, links = site
    starts = spark.createDataFrame([("e", B + "/")], "site string, url string")
    got = {r["url"][len(B):]: r["depth"] for r in graph.click_depths(starts, graph.graph_edges(links, pages), rows_per_part).collect()}
    assert (got["/"], got["/about"], got["/blog/post-1"], got["/deep/3"], got["/chain2"]) == (0, 1, 2, 5, 1)
    assert "/orphan" not in got


def test_redirect_walk(spark, site):
    pages, _ = site
    got = {r["url"][len(B):]: (r["hops"], r["is_loop"]) for r in graph.redirect_chains(pages).collect()}
    assert got == {"/old": (1, False), "/chain1": (2, False), "/chain2": (1, False)}
    ring = [("r", f"u{i}", 301, f"u{(i + 1) % 3}") for i in range(3)] + [("r", f"l{i}", 301, f"l{i + 1}") for i in range(20)]
    ring += [("r", f"m{i}", 301, f"m{(i + 1) % 15}") for i in range(15)] + [("r", "s", 301, "s")]
    walked = {r["url"]: (r["hops"], r["is_loop"]) for r in graph.redirect_chains(spark.createDataFrame(ring, "site string, url string, status int, redirect_to string")).collect()}
    assert walked["u0"] == (2, True) and walked["s"] == (0, True) and walked["l0"] == (20, False) and walked["l18"] == (2, False) and walked["m0"] == (14, True)


def test_findings_of_the_small_site(spark, site):
    pages, links = site
    starts = spark.createDataFrame([("e", B + "/")], "site string, url string")
    depths = graph.click_depths(starts, graph.graph_edges(links, pages))
    edges = audit.distinct_edges(links)
    base = pages.join(depths, ["site", "url"], "left").withColumn("depth", F.coalesce("depth", F.lit(-1)))
    base = base.join(audit.inlink_counts(edges).select("site", "url", "inlinks"), ["site", "url"], "left").withColumn("inlinks", F.coalesce("inlinks", F.lit(0)))
    html = F.col("status") == 200
    full = base.withColumns({
        "error": F.lit(None).cast("string"), "is_html": html, "title": F.concat(F.lit("A title that is long enough for it "), F.when(F.col("url").contains("post"), "x").otherwise(F.col("url"))),
        "title_px": F.lit(300), "meta_description": F.lit("d" * 100), "h1_count": F.lit(1), "h1": F.lit("h"), "word_count": F.lit(500), "canonical": F.col("url"), "lang": F.lit("en"), "viewport": F.lit(True),
        "open_graph": F.lit(True), "structured_data": F.lit(True), "images": F.lit(0), "images_missing_alt": F.lit(0), "internal_links": F.lit(1), "nofollow_internal": F.lit(0),
        "http_internal_links": F.lit(0), "mixed_content": F.lit(0), "content_hash": F.col("url"), "ttfb_ms": F.lit(100), "html_bytes": F.lit(2000), "compressed": F.lit(True)})
    images = spark.createDataFrame([("e", B + "/about", B + "/missing.png", 1), ("e", B + "/", B + "/ok.png", 2)], "site string, src string, dst string, ord int")
    externals = spark.createDataFrame([("e", B + "/", "https://o.org/gone", 1), ("e", B + "/", "https://o.org/fine", 2)], "site string, src string, dst string, ord int")
    checked = spark.createDataFrame([("e", B + "/missing.png", 404, None), ("e", B + "/ok.png", 200, None), ("e", "https://o.org/gone", 404, None), ("e", "https://o.org/fine", 200, None)],
                                    "site string, url string, status int, code string")
    sites = spark.createDataFrame([("e", B + "/", False, True, True, True)], "site string, final_url string, limit_reached boolean, robots_found boolean, sitemap_found boolean, apex_or_www boolean")
    probes = spark.createDataFrame([("e", "http", "http://e.com/", 200, None), ("e", "alt_host", "https://www.e.com/", 301, "x")], "site string, kind string, url string, status int, location string")
    findings = audit.find_issues(full, edges, images, externals, checked, graph.host_checks(sites, probes))
    got = {}
    for r in findings.collect():
        got.setdefault(r["issue"], []).append(r["url"].replace(B, ""))
    assert got["broken-internal-links"] == ["/"] and got["links-to-redirect"] == ["/"] and got["broken-images"] == ["/about"] and got["broken-external-links"] == ["/"]
    assert got["page-4xx"] == ["/broken"] and got["page-5xx"] == ["/error"] and got["redirect-chain"] == ["/chain1"] and got["blocked-by-robots"] == ["/private/secret"]
    assert got["orphan-page"] == ["/orphan"] and got["noindex-in-sitemap"] == ["/deep/3"] and got["sitemap-non-200"] == ["/old"] and got["http-not-redirected"] == ["http://e.com/"]
    assert sorted(got["deep-page"]) == ["/deep/2", "/deep/3"]
    # Pages with an error: /, /about, /broken, /error of the 13 that were fetched.
    assert audit.health_score(full, findings).first()["health_score"] == round(9 / 13 * 100)
    stats = audit.crawl_stats(full).first()
    assert (stats["client_errors"], stats["server_errors"], stats["redirects"], stats["blocked"]) == (1, 1, 3, 1)
    report = audit.audit_report(full, findings).first()
    assert report["stats"]["crawled"] == 14 and report["status_distribution"]["3xx"] == 3 and len(report["issues"]) == len(got)
    ids = {r["url"].replace(B, ""): r["issues"] for r in audit.pages_with_issues(full, findings).collect()}
    assert "page-4xx" in ids["/broken"]


def test_robots_rules_by_longest_match(spark):
    text = ("﻿User-agent: zzz\nUser-agent: Googlebot\nDisallow: /x # why\nAllow: /x/open\nSitemap: https://e.com/s.xml\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 2\nAllow: /*.html$\nHost e.com\n"
            "Dissallow: /t\nUser-agent: google\nDisallow: /g\nUser-agent: Googlebot\nDisallow:\nDisallow: /caf%C3%A9\n")
    file = spark.createDataFrame([("e", text, True), ("none", None, True), ("down", None, False)], "site string, text string, fetched boolean")
    cases = {"https://e.com/x": (False, False), "https://e.com/x/open": (True, False), "https://e.com/p.html": (True, True), "https://e.com/p.html?q": (True, False), "https://e.com/robots.txt": (True, True),
             "https://e.com/g": (True, False), "https://e.com/café": (False, False), "https://e.com/": (True, False)}
    urls = spark.createDataFrame([("e", u) for u in cases] + [("none", "https://n.com/x"), ("down", "https://d.com/x")], "site string, url string")
    got = {r["url"]: (r["googlebot"], r["other_bots"]) for r in robots.robots_access(urls, file).collect()}
    for url, want in cases.items():
        assert got[url] == want, url
    assert got["https://n.com/x"] == (True, True) and got["https://d.com/x"] == (None, None)
    lines = robots.robots_lines(file.where("text is not null"))
    summary = robots.robots_summary(lines).first()
    assert summary["sitemaps"] == ["https://e.com/s.xml"] and summary["invalid_lines"] == 2
    delay = robots.agent_rules(robots.robots_rules(lines), ["other"]).first()["by_token"]["other"]["delay"]
    assert delay == 2.0


def test_bodies_and_certificates(spark):
    import gzip

    rows = spark.createDataFrame([(1, bytearray("é".encode("cp1252")), "text/html; charset=windows-1252"), (2, bytearray(b"<meta charset='latin1'>\xe9"), None), (3, bytearray("é".encode()), "text/html"),
                                  (4, bytearray(b"\xff x"), None), (5, bytearray("é".encode()), "text/html; charset=nonsense")], "id int, body binary, content_type string")
    got = {r["id"]: r["html"] for r in responses.decode_body(rows).collect()}
    assert got == {1: "é", 2: "<meta charset='latin1'>é", 3: "é", 4: "� x", 5: "é"}
    packed = spark.createDataFrame([(1, bytearray(gzip.compress(b"<urlset/>"))), (2, bytearray(b"\x1f\x8bbroken")), (3, bytearray(b"plain")), (4, None)], "id int, body binary")
    assert {r["id"]: r["text"] for r in responses.gunzip_bodies(packed).collect()} == {1: "<urlset/>", 2: "", 3: "plain", 4: None}
    two = gzip.compress(b"<a>") + gzip.compress(b"<b>")
    files = [(1, two), (2, two + b"\0" * 9), (3, two[:-3]), (4, two + b"junk"), (5, gzip.compress(b"<a>")[:-9]), (6, b"plain"), (7, None)]
    got = {r["id"]: (r["text"], r["why"]) for r in responses.gunzip_bodies(spark.createDataFrame([(i, b and bytearray(b)) for i, b in files], "id int, body binary"), error="why").collect()}
    assert {i: got[i] for i in (1, 2, 3, 5, 6, 7)} == {1: ("<a><b>", None), 2: ("<a><b>", None), 3: ("<a>", "truncated"), 5: ("", "truncated"), 6: ("plain", None), 7: (None, None)}
    assert got[4][0] == "<a><b>" and got[4][1].startswith("corrupt: ")
    xml = "<urlset><url><loc> https://e.com/?a=1&amp;b=2 </loc><lastmod>2024-01-01</lastmod></url><url><loc><![CDATA[https://e.com/c]]></loc></url></urlset>"
    files = spark.createDataFrame([("e", "m.xml", xml), ("e", "bad", "<html>")], "site string, sitemap string, text string")
    assert [(r["loc"], r["lastmod"]) for r in responses.parse_sitemaps(files).orderBy("ord").collect()] == [("https://e.com/?a=1&b=2", "2024-01-01"), ("https://e.com/c", None)]


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("key"), "id")
    hot = ranking.hot_keys(rows, ["key"], 100)
    assert [r["key"] for r in hot.collect()] == ["hot"]
    lookup = rows.select("key").distinct().withColumn("v", F.length("key"))
    joined = ranking.spread(rows, hot, ["key"], ["id"]).join(ranking.fan_out(lookup, hot, ["key"]), ["key", "_part"])
    assert joined.count() == 3000 and joined.where("key = 'hot'").select("_part").distinct().count() == 10


def test_global_ordinals_and_peaks_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    data = [(i, rnd.choice([1, 1, 1, rnd.randrange(50)])) for i in range(3000)]
    got = {r["id"]: r["o"] for r in ranking.with_ordinal(spark.createDataFrame(data, "id int, v int"), -F.col("v"), "id", "o", buckets=16).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])))}
    assert got == want
    events = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", rnd.randrange(100_000), rnd.choice([1, -1])) for _ in range(2000)]
    frame = spark.createDataFrame(events, "key string, t long, delta int").withColumn("at", F.timestamp_seconds("t"))
    peaks = {r["key"]: r["peak"] for r in ranking.peak_running_sum(frame, ["key"], "at", "delta", 1000).collect()}
    for key in {e[0] for e in events}:
        run, best = 0, -10**9
        for _, _, delta in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            run += delta
            best = max(best, run)
        assert peaks[key] == best


def test_all_sitemaps_are_read_or_said_to_be_left_out(spark):
    leaves = [("s", f"m{i}", "urlset", f"https://s/{i}", i, None) for i in range(12)]
    index = [("s", "root", "index", f"m{i}", i, None) for i in range(12)]
    entries = spark.createDataFrame(index + leaves, "site string, sitemap string, kind string, loc string, ord long, lastmod string")
    roots = spark.createDataFrame([("s", "root", 0)], "site string, sitemap string, ord long")
    for limit, urls, partial in ((None, 12, False), (5, 4, True)):
        rows = graph.collect_sitemap_urls(graph.expand_sitemaps(roots, entries, limit), entries).collect()
        assert (len(rows), {r["partial"] for r in rows}) == (urls, {partial})


def test_volumes_and_prefixes_keep_to_their_market(spark):
    from sitegrain.operators import keywords

    asked = spark.createDataFrame([("d", "red shoes", "us", 1, 1), ("e", "red shoes", "de", 1, 1)], "domain string, keyword string, gl string, origin_order int, position int")
    volumes = spark.createDataFrame([("red shoes", "us", 500), ("red shoes", "de", 70), ("red shoes", "fr", 9000)], "keyword string, gl string, volume long")
    assert sorted((r["domain"], r["volume"]) for r in keywords.keywords_from_volumes(asked, volumes).collect()) == [("d", 500), ("e", 70)]
    lists = [("us", "red", ["red shoes"]), ("us", "red shoes", ["red shoes"]), ("de", "red sho", ["x", "red shoes"]), ("de", "red shoes", ["red shoes"])]
    prefixes = spark.createDataFrame(lists, "gl string, prefix string, suggestions array<string>")
    assert sorted((r["gl"], r["prefix"]) for r in keywords.shortest_prefixes(asked, prefixes).collect()) == [("de", "red sho"), ("us", "red")]
