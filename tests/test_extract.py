from pyspark.sql import functions as F

from sitegrain.operators import checks, extract, tech

HTML = """<!-- note --><!doctype html><html lang=" en-GB "><head><title>Hello &amp; bye  now</title><title>Second</title>
<meta name=Description content=" A  b "><meta name="robots" content="noindex"><meta name="googlebot" content="nofollow"><meta property="og:title" content="T"><meta property="og:title" content="U">
<meta name="twitter:card" content="summary"><meta http-equiv="Content-Type" content="text/html; charset=latin1"><base href="/x/"><link rel="canonical" href="a/../b">
<link rel="alternate" hreflang="DE" href="/de"><link rel="shortcut icon" href="i.ico"><link rel="stylesheet" href="http://e.com/s.css"><link rel="amphtml" href="/amp">
<script type="application/ld+json">{"@type":"A","@graph":[{"@type":["B","C"]}],"x":{"@type":"D"}}</script><script type="application/ld+json">{bad</script>
<script>var a="<h1>no</h1>";</script><script src="/js/app.js"></script><style>p{}</style></head>
<body><nav><a href="home" rel="nofollow UGC">Home</a></nav><main itemscope itemtype="https://schema.org/Product"><h1>One <b>two</b></h1><h3>Sub</h3><p>Some text<p>more<br>here
<a href="https://www.e.com/p#f"><img src=i.png alt=" pic "></a><a href="mailto:x@y.z">m</a><a href="http://other.org/" aria-label="Other"></a><img data-src=http://z.com/q.png><img srcset="s1.png 1x, s2.png 2x" alt="">
<form action="http://e.com/s"></form><iframe src="http://f.com/"></iframe><svg><title>no</title></svg><noscript>hidden javascript</noscript></main><footer>foot</footer></body></html>"""


def test_every_field(spark):
    row = extract.extract_pages(spark.createDataFrame([("https://e.com/d/p?q=1", HTML)], "url string, html string")).first()
    assert (row["title"], row["title_count"], row["meta_description"], row["lang"], row["charset"]) == ("Hello & bye now", 2, "A b", "en-GB", "latin1")
    assert (row["meta_robots"], row["canonical"], row["canonical_count"], row["base_href"]) == ("noindex, nofollow", "https://e.com/x/b", 1, "/x/")
    assert row["h1"] == ["One two"] and [h["level"] for h in row["headings"]] == [1, 3]
    assert [(x["href"], x["text"], x["internal"], x["nofollow"], x["in_nav"]) for x in row["links"]] == [
        ("https://e.com/x/home", "Home", True, True, True), ("https://www.e.com/p", "pic", True, False, False), ("http://other.org/", "Other", False, False, False)]
    assert [(i["src"], i["alt"]) for i in row["images"]] == [("https://e.com/x/i.png", "pic"), ("http://z.com/q.png", None), ("https://e.com/x/s1.png", "")]
    assert row["scripts"] == ["https://e.com/js/app.js"] and row["stylesheets"] == ["http://e.com/s.css"]
    assert [(h["lang"], h["href"]) for h in row["hreflang"]] == [("de", "https://e.com/de")]
    assert row["open_graph"] == {"og:title": "T"} and row["twitter"] == {"twitter:card": "summary"}
    assert [(j["types"], j["valid"]) for j in row["json_ld"]] == [(["A", "B", "C", "D"], True), ([], False)]
    assert row["microdata_types"] == ["Product"] and row["favicon"] == "https://e.com/x/i.ico" and row["amp_html"] == "https://e.com/amp"
    assert row["mixed_content"] == ["http://e.com/s.css", "http://f.com/"]
    assert [(f["action"], f["insecure"]) for f in row["forms"]] == [("http://e.com/s", True)]
    assert row["iframes"] == 1 and row["inline_style_bytes"] == 3 and row["inline_script_bytes"] == len('var a="<h1>no</h1>";')
    assert row["main_text"] == "One two Sub Some text more here m" and row["all_text"] == "Home One two Sub Some text more here m foot"


def test_scanner_survives_broken_and_deep_markup(spark):
    deep = "<div>" * 20000 + "end" + "</div>" * 20000
    nodes, text, main = extract.scan(deep, "https://e.com/")
    assert text == "end" and main == "end"
    for html in ["<a href='x", "<p <b>x", "<script>never closed", "<!-- open", "a < b > c", "<a href=\"http://[bad\">t</a>", ""]:
        extract.scan(html, "https://e.com/")
    assert extract.scan("<title>A</title><p>x", "https://e.com/")[1] == "x"


def test_page_states(spark):
    row = spark.range(1).select(
        extract.has_doctype(F.lit(HTML)).alias("doctype"),
        extract.looks_client_rendered(F.lit('<div id="root"> </div>'), F.lit(3), F.lit(0), F.array().cast("array<string>")).alias("shell"),
        extract.rejected(F.lit("application/pdf"), F.lit(200)).alias("pdf"), extract.rejected(F.lit(None).cast("string"), F.lit(200)).alias("none"),
        extract.indexable(F.lit(False), F.lit(200), F.lit(None).cast("boolean")).alias("indexable"),
        extract.security_headers(F.create_map(F.lit("content-security-policy"), F.lit("x" * 400))).alias("sec"),
        extract.result_preview(F.lit(None).cast("string"), F.array(F.lit("Head")), F.lit("https://www.e.com/a%20b/c"), F.lit(""), F.lit("body")).alias("p")).first()
    assert row["doctype"] and row["shell"] and row["pdf"] and not row["none"] and row["indexable"]
    assert len(row["sec"]["content_security_policy"]) == 300
    assert (row["p"]["title"], row["p"]["description"], row["p"]["breadcrumb"]) == ("Head", "body", "e.com › a b › c")


def full_page(spark):
    rows = spark.createDataFrame([("https://e.com/d/p_q", HTML)], "url string, html string").withColumn("raw", F.col("html"))
    page = extract.page_facts(extract.scan_pages(rows))
    return page.withColumns({
        "status": F.lit(200), "redirect_count": F.lit(2), "ttfb_ms": F.lit(700), "html_bytes": F.lit(5000), "compressed": F.lit(False), "has_doctype": F.lit(True), "noindex": F.lit(True),
        "googlebot": F.lit(True), "bingbot": F.lit(False), "js_rendered": F.lit(False), "keyword": F.lit("Some text"),
        "headers": F.create_map(F.lit("content-security-policy"), F.lit("frame-ancestors 'none'"), F.lit("referrer-policy"), F.lit("origin"))})


def test_checks_and_score(spark):
    found = {r["check_id"]: (r["status"], r["weight"]) for r in checks.page_checks(full_page(spark)).collect()}
    want = {
        "http-status": "pass", "indexable": "fail", "robots-txt": "warn", "canonical": "info", "redirects": "warn", "url": "warn", "hreflang": "warn", "title": "warn", "title-multiple": "warn",
        "description": "warn", "viewport": "fail", "heading-order": "warn", "h1": "pass", "word-count": "fail", "kw-title": "warn", "kw-intro": "pass", "kw-density": "warn", "img-alt": "warn",
        "img-dimensions": "warn", "open-graph": "warn", "twitter-card": "pass", "structured-data": "fail", "favicon": "pass", "ttfb": "warn", "compression": "warn", "https": "pass",
        "mixed-content": "fail", "insecure-forms": "fail", "security-headers": "pass", "nofollow-internal": "warn", "external-links": "info"}
    assert {k: found[k][0] for k in want} == want
    assert found["canonical"][1] == 0 and "meta-keywords" not in found and "inline-js" not in found
    earned = sum(w * {"pass": 1, "warn": 0.5}.get(s, 0) for s, w in found.values() if s != "info")
    total = sum(w for s, w in found.values() if s != "info")
    assert checks.page_scores(checks.page_checks(full_page(spark))).first()["score"] == int(earned / total * 100 + 0.5)
    assert len({c.id for c in checks.page_check_registry()}) == 44


def test_technology_evidence_order_and_version(spark):
    rows = spark.createDataFrame(
        [("u", '<script src="/wp-content/a.js"></script><div class="x svelte-abc12">', {"x-powered-by": "PHP/8", "server": "nginx"}, ["https://c.com/jquery-3.1.min.js"], "WordPress 6.4")],
        "url string, html string, headers map<string,string>, scripts array<string>, generator string")
    got = {r["name"]: (r["version"], r["evidence"]) for r in tech.detect_technologies(rows, "url").collect()}
    assert got["WordPress"] == ("6.4", "Generator meta tag: WordPress 6.4")
    assert got["PHP"][1] == "Header x-powered-by: PHP/8" and got["jQuery"][1] == "Script URL" and got["Svelte"][1].startswith("HTML contains")
    assert set(got) == {"WordPress", "PHP", "jQuery", "Svelte", "Nginx"} and len(tech.SIGNATURES) == 131
