"""Site audit: 48 issue rules over landed pages and links, rollups, health score and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls as ur
from sitegrain.operators.graph import redirect_chains
from sitegrain.operators.ranking import count_with_examples, top_n
from sitegrain.session import cut_lineage, forget

# Issue ids and severities.
SEVERITY = {
    "site-not-https": "error",
    "http-not-redirected": "warning",
    "host-duplicate": "warning",
    "page-4xx": "error",
    "page-5xx": "error",
    "page-failed": "error",
    "broken-internal-links": "error",
    "broken-images": "error",
    "redirect-loop": "error",
    "missing-title": "error",
    "duplicate-title": "error",
    "mixed-content": "error",
    "canonical-to-broken": "error",
    "missing-description": "warning",
    "duplicate-description": "warning",
    "title-too-long": "warning",
    "title-too-short": "notice",
    "description-too-long": "notice",
    "description-too-short": "notice",
    "missing-h1": "warning",
    "multiple-h1": "notice",
    "missing-alt": "warning",
    "slow-page": "warning",
    "large-page": "warning",
    "low-word-count": "warning",
    "duplicate-content": "warning",
    "redirect-chain": "warning",
    "broken-external-links": "warning",
    "missing-viewport": "warning",
    "orphan-page": "warning",
    "sitemap-non-200": "warning",
    "noindex-in-sitemap": "warning",
    "http-internal-links": "warning",
    "missing-canonical": "notice",
    "non-canonical": "notice",
    "noindex-page": "notice",
    "links-to-redirect": "notice",
    "deep-page": "notice",
    "single-inlink": "notice",
    "nofollow-internal": "notice",
    "dead-end": "notice",
    "missing-lang": "notice",
    "missing-og": "notice",
    "no-structured-data": "notice",
    "uncompressed": "notice",
    "blocked-by-robots": "notice",
    "no-robots": "notice",
    "no-sitemap": "notice",
}
SITE_ISSUES = {"site-not-https", "http-not-redirected", "host-duplicate", "no-robots", "no-sitemap"}
SEVERITY_ORDER = {"error": 0, "warning": 1, "notice": 2}
# Connection errors that mean an external target is really gone.
DEAD_CODES = ["ENOTFOUND", "ECONNREFUSED", "CERT_HAS_EXPIRED", "ERR_TLS_CERT_ALTNAME_INVALID", "DEPTH_ZERO_SELF_SIGNED_CERT"]


def broken_internal(status: Column) -> Column:
    return (status == 0) | status.between(400, 599)


def broken_external(status: Column, code: Column) -> Column:
    return status.isin(404, 410) | ((status >= 500) & (status != 503)) | ((status == 0) & F.coalesce(code.isin(DEAD_CODES), F.lit(False)))


def broken_image(status: Column, code: Column) -> Column:
    return status.isin(404, 410) | (status >= 500) | ((status == 0) & F.coalesce(code == "ENOTFOUND", F.lit(False)))


def broken_link_check(status: Column) -> Column:
    return status.isin(0, 404, 410) | (status >= 500)


def is_html_page(status: Column, content_type: Column) -> Column:
    return (status == 200) & F.coalesce(content_type, F.lit("text/html")).rlike("(?i)html")


def counts_for_duplicates() -> Column:
    return ~F.coalesce(F.col("noindex"), F.lit(False)) & (F.coalesce(F.col("canonical"), F.col("url")) == F.col("url"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def status_rules() -> dict[str, tuple[Column, Column | None]]:
    """Issue id to (condition, detail) for rules on the response alone."""
    s = F.col("status")
    return {
        "blocked-by-robots": (s == -1, None),
        "page-failed": (s == 0, F.col("error")),
        "page-4xx": (s.between(400, 499), _text("HTTP ", s, " · linked from ", F.coalesce(F.col("raw_inlinks"), F.lit(0)), " page(s)")),
        "page-5xx": (s >= 500, _text("HTTP ", s)),
        "sitemap-non-200": (F.col("in_sitemap") & (s != 200) & (s > 0), _text("HTTP ", s)),
    }


def content_rules() -> dict[str, tuple[Column, Column | None]]:
    """Issue id to (condition, detail) for rules on HTML pages with status 200. Users may add entries."""
    c = F.col
    empty = lambda name: F.coalesce(c(name), F.lit("")) == ""
    some = lambda name: F.coalesce(c(name), F.lit(0)) > 0
    size = lambda name: F.length(c(name))
    indexable, words = counts_for_duplicates(), F.coalesce(c("word_count"), F.lit(0))
    return {
        "missing-title": (empty("title"), None),
        "title-too-long": (~empty("title") & (c("title_px") > 600), _text(size("title"), " chars · ~", c("title_px"), "px")),
        "title-too-short": (~empty("title") & (c("title_px") <= 600) & (size("title") < 30), _text(size("title"), " chars: “", c("title"), "”")),
        "missing-description": (empty("meta_description"), None),
        "description-too-long": (size("meta_description") > 160, _text(size("meta_description"), " chars")),
        "description-too-short": (~empty("meta_description") & (size("meta_description") < 70), _text(size("meta_description"), " chars")),
        "missing-h1": (~some("h1_count"), None),
        "multiple-h1": (c("h1_count") > 1, _text(c("h1_count"), " H1 tags")),
        "missing-alt": (some("images_missing_alt"), _text(c("images_missing_alt"), " of ", c("images"), " images")),
        "slow-page": (c("ttfb_ms") > 1000, _text(c("ttfb_ms"), " ms")),
        "large-page": (c("html_bytes") > 1024 * 1024, _text(F.format_string("%.1f", c("html_bytes") / (1024 * 1024)), " MB")),
        "low-word-count": (indexable & (words < 200), _text(words, " words")),
        "missing-viewport": (~F.coalesce(c("viewport"), F.lit(False)), None),
        "mixed-content": (some("mixed_content"), _text(c("mixed_content"), " insecure resource(s)")),
        "http-internal-links": (some("http_internal_links") & c("https_site"), _text(c("http_internal_links"), " link(s)")),
        "missing-canonical": (empty("canonical"), None),
        "non-canonical": (~empty("canonical") & (c("canonical") != c("url")), _text("→ ", c("canonical"))),
        "noindex-page": (c("noindex"), None),
        "noindex-in-sitemap": (c("noindex") & c("in_sitemap"), None),
        "deep-page": (c("depth") > 3, _text(c("depth"), " clicks")),
        "nofollow-internal": (some("nofollow_internal"), _text(c("nofollow_internal"), " link(s)")),
        "dead-end": (c("internal_links") == 0, None),
        "missing-lang": (empty("lang"), None),
        "missing-og": (~F.coalesce(c("open_graph"), F.lit(False)), None),
        "no-structured-data": (~F.coalesce(c("structured_data"), F.lit(False)), None),
        "uncompressed": (~c("compressed") & (c("html_bytes") > 1024), None),
        "single-inlink": (indexable & (c("depth") > 0) & (c("inlinks") == 1), None),
        "orphan-page": (~c("limit_reached") & c("in_sitemap") & (c("depth") != 0) & (c("inlinks") == 0), None),
    }


def page_issues(pages: DataFrame, rules=None, ids: set[str] | None = None) -> DataFrame:
    """Findings of the page-local rules, of all or of some ids, in one scan: ``(site, issue, url, detail)``. Works on a stream as well."""
    live = F.col("is_html") & (F.col("status") == 200)
    content = {k: (live & cond, detail) for k, (cond, detail) in content_rules().items()} if rules is None else rules
    every = {**status_rules(), **content} if rules is None else content
    every = every if ids is None else {k: rule for k, rule in every.items() if k in ids}
    flags = F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(k).alias("issue"), (F.lit(None).cast("string") if d is None else d).alias("detail")))
        for k, (cond, d) in every.items()
    ])
    hits = F.explode(F.filter(flags, lambda f: f.isNotNull()))
    return pages.select("site", "url", hits.alias("hit")).select("site", "hit.issue", "url", "hit.detail")


def duplicate_issues(pages: DataFrame, ids: set[str] | None = None) -> DataFrame:
    """Titles, descriptions and contents shared by several indexable pages of a site; of all three issues or some ids.

    Group sizes are counted with map-side partial sums; only values used more than once are joined back, a join that
    adaptive execution splits when one value is on very many pages.
    """
    html = pages.where(F.col("is_html") & (F.col("status") == 200)).where(counts_for_duplicates())
    values = {
        "duplicate-title": F.nullif("title", F.lit("")), "duplicate-description": F.nullif("meta_description", F.lit("")),
        "duplicate-content": F.when(F.col("word_count") >= 50, F.col("content_hash")),
    }
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), v.alias("value")) for k, v in values.items() if ids is None or k in ids]))
    rows = html.select("site", "url", value.alias("v")).select("site", "url", "v.issue", "v.value").where("value is not null")
    shared = rows.groupBy("site", "issue", "value").agg(F.count("*").alias("n")).where("n > 1")
    detail = (
        F.when(F.col("issue") == "duplicate-title", _text("“", F.substring("value", 1, 70), "” used on ", F.col("n"), " pages"))
        .when(F.col("issue") == "duplicate-description", _text("Shared by ", F.col("n"), " pages"))
        .otherwise(_text("Same content as ", F.col("n") - 1, " other page(s)"))
    )
    return rows.join(shared, ["site", "issue", "value"]).select("site", "issue", "url", detail.alias("detail"))


def distinct_edges(links: DataFrame) -> DataFrame:
    """One row per (site, src, dst); the first ordinal is kept."""
    return links.groupBy("site", "src", "dst").agg(F.min("ord").alias("ord"))


def inlink_counts(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """Distinct sources per target: ``inlinks`` without the self link and ``raw_inlinks`` with it. Edges that are known to be ``distinct`` aren't shuffled for that."""
    once = edges.select("site", "src", "dst")
    return (once if distinct else once.distinct()).groupBy("site", F.col("dst").alias("url")).agg(
        F.count_if(F.col("src") != F.col("dst")).cast("int").alias("inlinks"), F.count("*").cast("int").alias("raw_inlinks"))


def link_targets(edges: DataFrame, pages: DataFrame, checks: DataFrame) -> DataFrame:
    """Edges with the status of their target: the crawled page, else the link check; unknown or blocked are dropped."""
    crawled = pages.select("site", F.col("url").alias("dst"), F.col("status").alias("_page"))
    checked = checks.select("site", F.col("url").alias("dst"), F.col("status").alias("_check"))
    joined = edges.join(crawled, ["site", "dst"], "left").join(checked, ["site", "dst"], "left")
    return joined.withColumn("status", F.coalesce("_page", "_check")).drop("_page", "_check").where(F.col("status") != -1)


def faulty_targets(edges: DataFrame, pages: DataFrame, checks: DataFrame, moved: bool = True) -> DataFrame:
    """Edges to broken targets, and redirecting ones unless not ``moved``, with their status. The targets are filtered before the edges meet them, so edges
    are shuffled once."""
    crawled = pages.select("site", F.col("url").alias("dst"), "status")
    checked = checks.select("site", F.col("url").alias("dst"), "status").join(crawled.select("site", "dst"), ["site", "dst"], "left_anti")
    broken = broken_internal(F.col("status"))
    faulty = crawled.unionByName(checked).where(broken | F.col("status").between(300, 399) if moved else broken)
    return edges.join(faulty, ["site", "dst"])


def link_rows(targets: DataFrame) -> DataFrame:
    """Broken and redirecting targets per source page, ``(site, src, issue, item)``."""
    s = F.col("status")
    label = F.concat("dst", F.lit(" ("), F.when(s == 0, "failed").otherwise(s.cast("string")), F.lit(")"))
    broken, moved = broken_internal(s), s.between(300, 399)
    return targets.where(broken | moved).select(
        "site", "src", F.when(broken, "broken-internal-links").otherwise("links-to-redirect").alias("issue"), F.when(broken, label).otherwise(F.col("dst")).alias("item"))


def image_rows(images: DataFrame, checks: DataFrame) -> DataFrame:
    """``images(site, src, dst)`` are distinct page and image pairs."""
    bad = checks.where(broken_image(F.col("status"), F.col("code"))).select("site", F.col("url").alias("dst"))
    return images.join(bad, ["site", "dst"]).select("site", "src", F.lit("broken-images").alias("issue"), F.col("dst").alias("item"))


def source_findings(rows: DataFrame) -> DataFrame:
    """Findings per source page from ``(site, src, issue, item)`` rows: how many items, and the first few."""
    found = count_with_examples(rows, ["site", "src", "issue"], "item", 3)
    n, e, issue = F.col("count"), F.col("examples"), F.col("issue")
    listed = lambda k: F.concat(_text(n, " broken: "), F.array_join(F.slice(e, 1, k), ", "))
    detail = (
        F.when(issue == "links-to-redirect", F.concat(_text(n, " link(s), e.g. "), F.get(e, F.lit(0))))
        .when(issue == "broken-internal-links", F.concat(listed(3), F.when(n > 3, "…").otherwise("")))
        .otherwise(listed(2))
    )
    return found.select("site", "issue", F.col("src").alias("url"), detail.alias("detail"))


def broken_link_issues(targets: DataFrame) -> DataFrame:
    return source_findings(link_rows(targets).where("issue = 'broken-internal-links'"))


def redirect_link_issues(targets: DataFrame) -> DataFrame:
    return source_findings(link_rows(targets).where("issue = 'links-to-redirect'"))


def broken_image_issues(images: DataFrame, checks: DataFrame) -> DataFrame:
    return source_findings(image_rows(images, checks))


def check_sources(edges: DataFrame, checks: DataFrame, n: int | None = None) -> DataFrame:
    """Checked URLs with their source pages; all of them, or the first n."""
    rows = edges.join(checks.select("site", F.col("url").alias("dst"), "status", "code"), ["site", "dst"])
    return rows if n is None else top_n(rows, ["site", "dst"], [F.col("ord"), F.col("src")], n)


def external_rows(edges: DataFrame, checks: DataFrame) -> DataFrame:
    """Every source page of a broken external URL is told about it."""
    label = F.concat("dst", F.lit(" ("), F.when(F.col("status") == 0, F.col("code")).otherwise(F.col("status").cast("string")), F.lit(")"))
    bad = checks.where(broken_external(F.col("status"), F.col("code")))
    return check_sources(edges, bad).select("site", "src", F.lit("broken-external-links").alias("issue"), label.alias("item"))


def broken_external_issues(edges: DataFrame, checks: DataFrame) -> DataFrame:
    return source_findings(external_rows(edges, checks))


def canonical_issues(pages: DataFrame) -> DataFrame:
    """Canonical URLs that are crawled and broken."""
    targets = pages.where(broken_internal(F.col("status"))).select("site", F.col("url").alias("canonical"), F.col("status").alias("_target"))
    pointing = pages.where(F.col("is_html") & (F.col("status") == 200) & (F.col("canonical") != F.col("url")))
    what = F.when(F.col("_target") == 0, "failed").otherwise(F.col("_target").cast("string"))
    return pointing.select("site", "url", "canonical").join(targets, ["site", "canonical"]).select(
        "site", F.lit("canonical-to-broken").alias("issue"), "url", F.concat("canonical", F.lit(" ("), what, F.lit(")")).alias("detail"))


def redirect_issues(pages: DataFrame) -> DataFrame:
    walk = redirect_chains(pages)
    line = F.array_join("chain", " → ")
    return walk.where(F.col("is_loop") | (F.col("hops") > 1)).select(
        "site", F.when(F.col("is_loop"), "redirect-loop").otherwise("redirect-chain").alias("issue"), "url",
        F.when(F.col("is_loop"), line).otherwise(F.concat(_text(F.col("hops"), " hops: "), line)).alias("detail"))


def site_issues(sites: DataFrame) -> DataFrame:
    """Findings on whole sites from ``host_checks`` rows with ``robots_found`` and ``sitemap_found``."""
    origin = ur.origin_of(F.col("final_url"))
    none = F.lit(None).cast("string")
    host = ur.authority_of(F.col("final_url"))

    def flag(cond: Column, issue: str, url: Column, detail: Column = none) -> Column:
        return F.when(cond, F.struct(F.lit(issue).alias("issue"), url.alias("url"), detail.alias("detail")))

    flags = F.array(
        flag(~F.col("final_url").startswith("https:"), "site-not-https", F.col("final_url")),
        flag((F.col("https_redirect") == "no-redirect") & F.col("http_url").isNotNull(), "http-not-redirected", F.col("http_url"), F.lit("Returns 200 over HTTP")),
        flag((F.col("host_canonicalization") == "duplicate") & F.col("alternate_host_url").isNotNull(), "host-duplicate", F.col("alternate_host_url"),
             F.concat(F.lit("Also serves content; should redirect to "), host)),
        flag(~F.col("robots_found"), "no-robots", F.concat(origin, F.lit("/robots.txt"))),
        flag(~F.col("sitemap_found"), "no-sitemap", F.concat(origin, F.lit("/sitemap.xml"))),
    )
    hits = F.explode(F.filter(flags, lambda f: f.isNotNull()))
    return sites.select("site", hits.alias("h")).select("site", "h.issue", "h.url", "h.detail")


def find_issues(
    pages: DataFrame, edges: DataFrame, images: DataFrame, externals: DataFrame, checks: DataFrame, sites: DataFrame, ids: set[str] | None = None, detail: bool = True
) -> DataFrame:
    """All findings, ``(site, issue, severity, url, detail)``. ``pages`` carries the columns of ``audit_pages``.

    With ``ids`` only those rules run, and joins that only others need are left out; without ``detail`` that column is null and no examples are
    gathered. Findings on links, images and externals are written before this returns; edges are read later only for ``raw_inlinks``, if pages don't carry it.
    """
    wanted = set(SEVERITY) if ids is None else set(ids)
    parts = [site_issues(sites).where(F.col("issue").isin(*sorted(wanted)))] if wanted & SITE_ISSUES else []
    local = wanted & {*status_rules(), *content_rules()}
    if local:
        facts = sites.select("site", F.col("final_url").startswith("https:").alias("https_site"), "limit_reached")
        full = pages.join(facts, "site")
        if "raw_inlinks" not in full.columns:
            counted = detail and "page-4xx" in local
            full = full.join(inlink_counts(edges).select("site", "url", "raw_inlinks"), ["site", "url"], "left") if counted else full.withColumn("raw_inlinks", F.lit(None).cast("int"))
        parts.append(page_issues(full, ids=local))
    if wanted & {"duplicate-title", "duplicate-description", "duplicate-content"}:
        parts.append(duplicate_issues(pages, wanted))
    if wanted & {"redirect-loop", "redirect-chain"}:
        parts.append(redirect_issues(pages).where(F.col("issue").isin(*sorted(wanted))))
    if "canonical-to-broken" in wanted:
        parts.append(canonical_issues(pages))
    rows = []
    if wanted & {"broken-internal-links", "links-to-redirect"}:
        rows.append(link_rows(faulty_targets(edges, pages, checks, "links-to-redirect" in wanted)).where(F.col("issue").isin(*sorted(wanted))))
    if "broken-images" in wanted:
        rows.append(image_rows(images, checks))
    if "broken-external-links" in wanted:
        rows.append(external_rows(externals, checks))
    if rows:
        every = reduce(DataFrame.unionByName, rows)
        if detail:
            # The rows behind the per-source findings feed a count and a top-n; they are written once so that no join runs twice.
            settled = cut_lineage(every, lean=True)
            parts.append(cut_lineage(source_findings(settled), lean=True))
            forget(settled)
        else:
            once = every.select("site", "issue", F.col("src").alias("url")).distinct()
            parts.append(cut_lineage(once, lean=True).withColumn("detail", F.lit(None).cast("string")))
    found = with_severity(reduce(DataFrame.unionByName, parts or [site_issues(sites).where(F.lit(False))]))
    return found if detail else found.withColumn("detail", F.lit(None).cast("string"))


def with_severity(findings: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return findings.withColumn("severity", F.element_at(names, F.col("issue")))


def issue_rollup(findings: DataFrame, urls_per_issue: int | None = None) -> DataFrame:
    """Per site and issue: the full count and the URLs, all or the first ``urls_per_issue``. All of them are counted as they are listed, in one shuffle."""
    keys = ["site", "issue", "severity"]
    count, urls = F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("url", "detail"))).alias("urls")
    if urls_per_issue is None:
        return findings.groupBy(*keys).agg(count, urls)
    listed = top_n(findings, ["site", "issue"], [F.col("url"), F.col("detail")], urls_per_issue, "_pos")
    return findings.groupBy(*keys).agg(count).join(listed.groupBy("site", "issue").agg(urls), ["site", "issue"])


def issue_order() -> list[Column]:
    """Sort of an issue list: severity, then count, then name."""
    order = F.create_map(*[F.lit(x) for pair in SEVERITY_ORDER.items() for x in pair])
    return [F.element_at(order, F.col("severity")), F.col("count").desc(), F.col("issue")]


def severity_totals(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("site", "severity").agg(F.sum("count").alias("findings"), F.count("*").alias("issue_types"))


def pages_with_issues(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages with the ids of their issues; at most 48 distinct ids per page."""
    ids = findings.groupBy("site", "url").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    joined = pages.join(ids, ["site", "url"], "left")
    return joined.withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))


def health_score(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Share of fetched pages without an error-level issue, in whole percent; 0 for a site without pages."""
    dirty = findings.where("severity = 'error'").select("site", "url").distinct().withColumn("dirty", F.lit(True))
    rated = pages.select("site", "url", "status").join(dirty, ["site", "url"], "left")
    live = F.col("status") != -1
    total, clean = F.count_if(live), F.count_if(live & F.col("dirty").isNull())
    score = F.when(total == 0, F.lit(0)).otherwise(F.floor(clean / total * 100 + 0.5))
    return rated.groupBy("site").agg(score.cast("int").alias("health_score"))


def status_bucket(status: Column) -> Column:
    return F.when(status == -1, "Blocked").when(status == 0, "Failed").otherwise(F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


STATUS_KEYS = ["2xx", "3xx", "4xx", "5xx", "Failed", "Blocked"]


def status_distribution(pages: DataFrame) -> DataFrame:
    """Pages per status class; the six usual classes are listed even when empty."""
    counts = pages.groupBy("site", status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("pages"))
    blank = counts.select("site").distinct().select("site", F.explode(F.array(*[F.lit(k) for k in STATUS_KEYS])).alias("bucket"), F.lit(0).cast("bigint").alias("pages"))
    return counts.unionByName(blank).groupBy("site", "bucket").agg(F.sum("pages").alias("pages"))


def depth_distribution(pages: DataFrame) -> DataFrame:
    bucket = F.when(F.col("depth") >= 5, "5+").otherwise(F.col("depth").cast("string"))
    html = pages.where(F.col("is_html") & (F.col("status") == 200) & (F.col("depth") >= 0))
    return html.groupBy("site", bucket.alias("bucket")).agg(F.count("*").alias("pages"))


def crawl_stats(pages: DataFrame) -> DataFrame:
    s, html = F.col("status"), F.col("is_html")
    fetched = F.count_if(s > 0)
    return pages.groupBy("site").agg(
        F.count("*").alias("crawled"), F.count_if(html).alias("html"), F.count_if(s.between(300, 399)).alias("redirects"),
        F.count_if(s.between(400, 499)).alias("client_errors"), F.count_if(s >= 500).alias("server_errors"),
        F.count_if(s == 0).alias("failed"), F.count_if(s == -1).alias("blocked"), F.count_if((s == 200) & ~html).alias("non_html"),
        F.coalesce(F.floor(F.sum(F.when(s > 0, F.col("ttfb_ms"))) / F.nullif(fetched, F.lit(0)) + 0.5), F.lit(0)).alias("avg_ttfb_ms"),
        F.coalesce(F.sum(F.when(html, F.col("html_bytes"))), F.lit(0)).alias("total_html_bytes"),
    )


def link_counters(links: DataFrame) -> DataFrame:
    """Per source page: distinct internal targets; occurrences of external, nofollow-internal and http-internal links."""
    inside = F.col("internal")
    return links.groupBy("site", "src").agg(
        F.count_distinct(F.when(inside, F.col("dst"))).alias("internal_links"), F.count_if(~inside).alias("external_links"),
        F.count_if(inside & F.col("nofollow")).alias("nofollow_internal"),
        F.count_if(inside & F.col("src").startswith("https:") & F.col("dst").startswith("http:")).alias("http_internal_links"),
    )


def mark_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    listed = sitemap.select("site", F.col("loc").alias("url")).distinct().withColumn("_listed", F.lit(True))
    return pages.join(listed, ["site", "url"], "left").withColumn("in_sitemap", F.col("_listed").isNotNull()).drop("_listed")


def unchecked_resources(resources: DataFrame, images: DataFrame, pages: DataFrame, n: int = 2**31 - 1) -> DataFrame:
    """Files and images that were not crawled as pages, once each and numbered per site; all, or the first n."""
    both = resources.select("site", "dst", "ord").unionByName(images.select("site", "dst", "ord"))
    once = both.groupBy("site", "dst").agg(F.min("ord").alias("ord"))
    open_ = once.join(pages.select("site", F.col("url").alias("dst")), ["site", "dst"], "left_anti")
    return top_n(open_, ["site"], [F.col("ord"), F.col("dst")], n, "position")


def external_check_list(externals: DataFrame, per_host: int = 2**31 - 1, per_site: int = 2**31 - 1) -> DataFrame:
    """External targets to check, numbered per site in first-seen order: all, or so many per host and then per site."""
    once = externals.groupBy("site", "dst").agg(F.min("ord").alias("ord")).withColumn("host", ur.host_of(F.col("dst")))
    order = [F.col("ord"), F.col("dst")]
    return top_n(top_n(once, ["site", "host"], order, per_host), ["site"], order, per_site, "position")


def page_limit(pages: DataFrame, max_pages: int) -> DataFrame:
    """The first pages of each site in discovery order."""
    return top_n(pages, ["site"], [F.col("depth"), F.col("ord"), F.col("url")], max_pages, "position")


def audit_deadlines(start_ms: Column, limit_ms: Column) -> Column:
    """struct<crawl_until, check_until> of a crawl with a time budget; null when there is none."""
    return F.when(F.coalesce(limit_ms, F.lit(0)) > 0, F.struct(
        (start_ms + limit_ms - F.least(F.lit(70_000.0), limit_ms / 4)).alias("crawl_until"),
        (start_ms + limit_ms - F.least(F.lit(25_000.0), limit_ms / 10)).alias("check_until")))


def stop_reason(left_over: Column, crawled: Column, max_pages: Column, out_of_time: Column) -> Column:
    return F.when(left_over == 0, None).when(crawled >= max_pages, "page-limit").when(out_of_time, "time-limit")


def filter_pages(pages: DataFrame, text: str | None = None, status: str | None = None) -> DataFrame:
    """Page table filter: text in URL or title, status class ok / redirect / error."""
    out = pages
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "url", "title")), F.lit(text.lower())))
    s = F.col("status")
    classes = {"ok": s.between(200, 299), "redirect": s.between(300, 399), "error": (s == 0) | (s >= 400)}
    return out.where(classes[status]) if status else out


def external_view(checks: DataFrame, errors_only: bool = False) -> DataFrame:
    """Checked external links, lowest status first, with a note where a site turns bots away."""
    s = F.col("status")
    rows = checks.withColumn("bot_blocked", s.isin(401, 403, 429, 999))
    return (rows.where((s == 0) | (s >= 400)) if errors_only else rows).orderBy("status", "url")


def check_links(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Link list with the check results of its own site; ``broken`` follows the link checker's own rule."""
    joined = links.join(statuses.select("site", F.col("url").alias("href"), "status", "error"), ["site", "href"], "left")
    return joined.withColumn("broken", F.coalesce(broken_link_check(F.col("status")), F.lit(False)))


def filter_links(links: DataFrame, kind: str = "all", text: str | None = None) -> DataFrame:
    cond = {"all": F.lit(True), "internal": F.col("internal"), "external": ~F.col("internal"), "nofollow": F.col("nofollow"), "broken": F.col("broken")}[kind]
    out = links.where(cond)
    return out.where(F.contains(F.lower(F.concat_ws(" ", "href", "text")), F.lit(text.lower()))) if text else out


def audit_report(pages: DataFrame, findings: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """One row per site: score, statistics, distributions and the issue list."""
    rollup = issue_rollup(findings)
    issues = rollup.groupBy("site").agg(F.collect_list(F.struct("severity", "count", "issue", "urls")).alias("issues"))
    spread_ = status_distribution(pages).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "pages"))).alias("status_distribution"))
    depth = depth_distribution(pages).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "pages"))).alias("depth_distribution"))
    stats = crawl_stats(pages)
    stats = stats.select("site", F.struct(*[c for c in stats.columns if c != "site"]).alias("stats"))
    out = health_score(pages, findings)
    for part in (stats, spread_, depth, issues):
        out = out.join(part, "site", "left")
    return out
