"""On-page checks: one registry of Column rules, one long result table, one weighted score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import text as tx
from sitegrain.functions import urls as ur

PASS, WARN, FAIL, INFO = "pass", "warn", "fail", "info"


@dataclass
class Check:
    """``status`` is null where the check does not apply; ``weight`` may depend on the row."""

    id: str
    category: str
    weight: int | Column
    status: Column
    value: Column | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _warn_if(cond: Column) -> Column:
    return F.when(cond, WARN).otherwise(PASS)


def _header(name: str) -> Column:
    return F.coalesce(F.element_at(_c("headers"), F.lit(name)), F.lit(""))


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def heading_skips(headings: Column) -> Column:
    """Distinct jumps of more than one heading level, in order, such as ``H1→H3``."""
    level = lambda i: F.element_at(headings, i)["level"]
    steps = F.when(F.size(headings) > 1, F.sequence(F.lit(2), F.size(headings))).otherwise(F.array().cast("array<int>"))
    jumps = F.filter(steps, lambda i: level(i) > level(i - 1) + 1)
    return F.array_distinct(F.transform(jumps, lambda i: F.concat(F.lit("H"), level(i - 1).cast("string"), F.lit("→H"), level(i).cast("string"))))


def _contains(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    words = _c("kw_tokens")
    spread = (F.size(words) > 1) & (F.size(F.array_except(words, tx.tokenize(low))) == 0)
    return (low != "") & (F.contains(low, _c("kw")) | spread)


def page_check_registry() -> list[Check]:
    url, status, js = _c("url"), _c("status"), _c("js_rendered")
    title, desc, words = _c("title"), _c("meta_description"), _c("word_count")
    links, images, html_bytes = _c("links"), _c("images"), _c("html_bytes")
    https = url.startswith("https:")
    has_title, has_desc = F.coalesce(title, F.lit("")) != "", F.coalesce(desc, F.lit("")) != ""
    count = lambda arr, cond: F.size(F.filter(arr, cond))
    title_px, desc_px = tx.pixel_width(title, tx.TITLE_PX), tx.pixel_width(desc, tx.SNIPPET_PX)
    n_h1, skips = F.size("h1"), heading_skips(_c("headings"))
    path = ur.path_of(url)
    params = F.size(F.filter(F.split(F.regexp_replace(ur.query_of(url), r"^\?", ""), "&"), lambda p: p != ""))
    alternates = F.size("hreflang")
    og_missing = F.filter(F.array(*[F.lit(k) for k in ("og:title", "og:description", "og:image")]),
                          lambda k: F.coalesce(F.element_at(_c("open_graph"), k), F.lit("")) == "")
    card = F.coalesce(F.element_at(_c("twitter"), F.lit("twitter:card")), F.lit(""))
    bad_ld = count(_c("json_ld"), lambda j: ~j["valid"])
    types = structured_types()
    external = count(links, lambda x: ~x["internal"])
    nofollow_in = count(links, lambda x: x["internal"] & x["nofollow"])
    no_text = count(links, lambda x: x["text"] == "")
    no_alt = count(images, lambda i: i["alt"].isNull())
    no_size = count(images, lambda i: (F.coalesce(i["width"], F.lit("")) == "") | (F.coalesce(i["height"], F.lit("")) == ""))
    bad_forms = count(_c("forms"), lambda f: f["insecure"])
    shields = F.size(F.filter(F.array(
        _header("strict-transport-security") != "", _header("content-security-policy") != "", _header("x-content-type-options") != "",
        (_header("x-frame-options") != "") | _header("content-security-policy").rlike("(?i)frame-ancestors"), _header("referrer-policy") != "",
    ), lambda ok: ok))
    kw = _c("kw").isNotNull()
    slug = F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "[-_/]+", " ")
    intro = F.array_join(F.slice(F.split(_c("main_text"), tx.SPACE + "+"), 1, 100), " ")
    hits, n_tokens = _c("kw_hits"), _c("text_tokens")
    density = F.when(n_tokens > 0, hits * F.size("kw_tokens") / n_tokens * 100).otherwise(F.lit(0.0))
    when = F.when
    return [
        Check("http-status", "Indexing", 3, when(status.between(200, 299), PASS).otherwise(FAIL), status.cast("string")),
        Check("indexable", "Indexing", 3, when(_c("noindex"), FAIL).otherwise(PASS), when(_c("noindex"), "noindex").otherwise("indexable")),
        Check("robots-txt", "Indexing", 3, when(_c("googlebot").isNull(), None).when(~_c("googlebot"), FAIL).when(~_c("bingbot"), WARN).otherwise(PASS)),
        Check("canonical", "Indexing", when(_canonical_elsewhere(), 0).otherwise(2),
              when(_c("canonical").isNull() | (_c("canonical_count") > 1), WARN).when(_canonical_elsewhere(), INFO).otherwise(PASS), _c("canonical")),
        Check("redirects", "Indexing", 1, _warn_if(_c("redirect_count") >= 2), _c("redirect_count").cast("string")),
        Check("url", "Indexing", 1, _warn_if((F.length(url) > 115) | path.rlike("[A-Z]") | F.contains(path, F.lit("_")) | (params > 2))),
        Check("hreflang", "Indexing", 1, when(alternates > 0, when(F.exists("hreflang", lambda h: _bare(h["href"]) == _bare(url)), PASS).otherwise(WARN)), alternates.cast("string")),
        Check("title", "Meta tags", 3, when(~has_title, FAIL).when((title_px > tx.TITLE_LIMIT_PX) | (F.length(title) < 30), WARN).otherwise(PASS), title_px.cast("string")),
        Check("title-multiple", "Meta tags", 1, when(_c("title_count") > 1, WARN), _c("title_count").cast("string")),
        Check("description", "Meta tags", 2, when(~has_desc, FAIL).when((desc_px > tx.SNIPPET_LIMIT_PX) | (F.length(desc) > 160) | (F.length(desc) < 70), WARN).otherwise(PASS), desc_px.cast("string")),
        Check("viewport", "Meta tags", 2, when(F.coalesce(_c("viewport"), F.lit("")) == "", FAIL).otherwise(PASS), _c("viewport")),
        Check("lang", "Meta tags", 1, _warn_if(F.coalesce(_c("lang"), F.lit("")) == ""), _c("lang")),
        Check("charset", "Meta tags", 1, _warn_if((F.coalesce(_c("charset"), F.lit("")) == "") & ~_header("content-type").rlike("(?i)charset=")), _c("charset")),
        Check("doctype", "Meta tags", 1, _warn_if(~_c("has_doctype"))),
        Check("meta-keywords", "Meta tags", 0, when(F.coalesce(_c("meta_keywords"), F.lit("")) != "", INFO)),
        Check("js-rendering", "Content", 1, when(js, WARN)),
        Check("h1", "Content", 2, when(n_h1 == 1, PASS).when(n_h1 > 1, WARN).when(js, WARN).otherwise(FAIL), n_h1.cast("string")),
        Check("heading-order", "Content", 1, _warn_if(F.size(skips) > 0), F.array_join(F.slice(skips, 1, 3), ", ")),
        Check("word-count", "Content", 2, when(words >= 300, PASS).when(js | (words >= 50), WARN).otherwise(FAIL), words.cast("string")),
        Check("kw-title", "Keyword", 1, when(kw, when(_contains(title), PASS).otherwise(WARN))),
        Check("kw-description", "Keyword", 1, when(kw, when(_contains(desc), PASS).otherwise(WARN))),
        Check("kw-h1", "Keyword", 1, when(kw, when(F.exists("h1", _contains), PASS).otherwise(WARN))),
        Check("kw-url", "Keyword", 1, when(kw, when(_contains(slug), PASS).otherwise(WARN))),
        Check("kw-intro", "Keyword", 1, when(kw, when(_contains(intro), PASS).otherwise(WARN))),
        Check("kw-density", "Keyword", 1, when(kw, _warn_if((hits == 0) | (density > 4))), F.format_string("%.2f", density)),
        Check("internal-links", "Links", 1, _warn_if(F.size(links) - external == 0), (F.size(links) - external).cast("string")),
        Check("nofollow-internal", "Links", 1, when(nofollow_in > 0, WARN), nofollow_in.cast("string")),
        Check("anchor-text", "Links", 1, _warn_if(no_text > 0), no_text.cast("string")),
        Check("link-count", "Links", 1, when(F.size(links) > 300, WARN), F.size(links).cast("string")),
        Check("external-links", "Links", 0, F.lit(INFO), external.cast("string")),
        Check("img-alt", "Images", 2, when(F.size(images) > 0, _warn_if(no_alt > 0)), no_alt.cast("string")),
        Check("img-dimensions", "Images", 1, when(F.size(images) > 0, _warn_if(no_size / F.nullif(F.size(images), F.lit(0)) > 0.3)), no_size.cast("string")),
        Check("open-graph", "Social & rich results", 1, _warn_if(F.size(og_missing) > 0), F.array_join(og_missing, ", ")),
        Check("twitter-card", "Social & rich results", when(card != "", 1).otherwise(0), when(card != "", PASS).otherwise(INFO), F.nullif(card, F.lit(""))),
        Check("structured-data", "Social & rich results", 1, when(bad_ld > 0, FAIL).when(F.size(types) > 0, PASS).otherwise(WARN), F.array_join(F.slice(types, 1, 5), ", ")),
        Check("favicon", "Social & rich results", 1, _warn_if(F.coalesce(_c("favicon"), F.lit("")) == "")),
        Check("ttfb", "Performance", 2, when(_c("ttfb_ms") < 600, PASS).when(_c("ttfb_ms") < 1500, WARN).otherwise(FAIL), _c("ttfb_ms").cast("string")),
        Check("html-size", "Performance", 1, when(html_bytes < 1024 * 1024, PASS).when(html_bytes < 2 * 1024 * 1024, WARN).otherwise(FAIL), html_bytes.cast("string")),
        Check("compression", "Performance", 1, when(html_bytes > 1024, when(_c("compressed"), PASS).otherwise(WARN))),
        Check("inline-js", "Performance", 1, when(_c("inline_script_bytes") > 100 * 1024, WARN), _c("inline_script_bytes").cast("string")),
        Check("https", "Security", 3, when(https, PASS).otherwise(FAIL)),
        Check("mixed-content", "Security", 2, when(https, when(F.size("mixed_content") > 0, FAIL).otherwise(PASS)), F.size("mixed_content").cast("string")),
        Check("insecure-forms", "Security", 2, when(bad_forms > 0, FAIL), bad_forms.cast("string")),
        Check("security-headers", "Security", 1, when(shields >= 3, PASS).otherwise(WARN), shields.cast("string")),
    ]


def _canonical_elsewhere() -> Column:
    return F.coalesce((F.col("canonical_count") <= 1) & (_bare(F.col("canonical")) != _bare(F.col("url"))), F.lit(False))


def structured_types() -> Column:
    """Distinct schema types of valid JSON-LD and microdata."""
    return F.array_distinct(F.concat(F.flatten(F.transform("json_ld", lambda j: j["types"])), F.col("microdata_types")))


def page_checks(pages: DataFrame, registry: list[Check] | None = None, key: str = "url") -> DataFrame:
    """``(url, check_id, category, status, value, weight)``: all checks are made in one scan of the pages. ``key`` names pages that share an address."""
    keyword = F.nullif(F.trim(F.lower("keyword")), F.lit(""))
    tokens = F.when(F.col("kw").isNotNull(), tx.tokenize(F.col("main_text")))
    staged = (
        pages.withColumn("kw", keyword).withColumn("kw_tokens", tx.tokenize(F.col("kw")))
        .withColumn("_tokens", tokens)
        .withColumn("kw_hits", tx.phrase_occurrences(F.col("_tokens"), F.col("kw_tokens")))
        .withColumn("text_tokens", F.size("_tokens"))
    )
    results = F.array(*[
        F.when(c.status.isNotNull(), F.struct(
            F.lit(c.id).alias("check_id"), F.lit(c.category).alias("category"), c.status.alias("status"),
            (F.lit(None).cast("string") if c.value is None else c.value).alias("value"),
            (F.lit(c.weight) if isinstance(c.weight, int) else c.weight).alias("weight")))
        for c in (registry or page_check_registry())
    ])
    rows = F.explode(F.filter(results, lambda r: r.isNotNull()))
    return staged.select(key, rows.alias("r")).select(key, "r.*")


def page_scores(checks: DataFrame, key: str = "url") -> DataFrame:
    """Weighted share of passed checks per page, in whole percent; warnings count half."""
    scored = (F.col("status") != INFO) & (F.col("weight") > 0)
    earned = F.sum(F.when(scored, F.col("weight") * F.when(F.col("status") == PASS, 1.0).when(F.col("status") == WARN, 0.5).otherwise(0.0)))
    total = F.sum(F.when(scored, F.col("weight")))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (PASS, WARN, FAIL, INFO)]
    return checks.groupBy(key).agg(F.coalesce(F.floor(earned / total * 100 + 0.5), F.lit(0)).cast("int").alias("score"), *counts)


def order_checks(checks: DataFrame) -> DataFrame:
    """Failed checks first, then warnings, passes and notes."""
    order = F.create_map(*[F.lit(x) for p in {FAIL: 0, WARN: 1, PASS: 2, INFO: 3}.items() for x in p])
    return checks.withColumn("status_order", F.element_at(order, F.col("status")))
