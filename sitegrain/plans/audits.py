"""Audit, graph and window queries over landed sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import text as tx
from sitegrain.functions import urls as ur
from sitegrain.operators import audit, graph, ranking, robots
from sitegrain.plans.catalog import query
from sitegrain.plans.landed import derive, landed, over
from sitegrain.session import cut_lineage, forget
from sitegrain.sources import responses, sinks


def px_sql(expr: str, font: int) -> str:
    """Pixel width of a text in SQL, from the same width classes."""
    table: dict[str, int] = {}
    for chars, width in tx.ARIAL_WIDTHS:
        table.update(dict.fromkeys(chars, width))
    classes: dict[int, str] = {}
    for ch, width in table.items():
        classes[width] = classes.get(width, "") + ch
    case = " ".join(f"WHEN strpos('{c.replace(chr(39), chr(39) * 2)}', ch) > 0 THEN {w}" for w, c in classes.items())
    units = f"list_sum(list_transform(string_split({expr}, ''), lambda ch: CASE WHEN ch = '' THEN 0 {case} WHEN unicode(ch) > 11904 THEN 1000 ELSE 556 END))"
    return f"CAST(floor({units} / 1000 * {font} + 0.5) AS INT)"


def pages_of(spark, d):
    return landed(spark, d, "site_pages").withColumn("title_px", F.coalesce(tx.pixel_width(F.col("title"), 20), F.lit(0)))


def edges_of(spark, d):
    return audit.distinct_edges(landed(spark, d, "site_links"))


def full_pages(spark, d):
    """Pages with their inlink counts and site facts, ready for the page rules."""
    sites = landed(spark, d, "sites").select("site", F.col("final_url").startswith("https:").alias("https_site"), "limit_reached")
    pages = pages_of(spark, d).join(audit.inlink_counts(edges_of(spark, d)), ["site", "url"], "left")
    return pages.withColumn("inlinks", F.coalesce("inlinks", F.lit(0))).join(sites, "site")


EDGES = "edges AS (SELECT site, src, dst, min(ord) AS ord FROM site_links GROUP BY site, src, dst)"
INLINKS = f"""{EDGES}, inl AS (SELECT site, dst AS url, CAST(count(*) FILTER (WHERE src <> dst) AS INT) AS inlinks, CAST(count(*) AS INT) AS raw_inlinks
    FROM edges GROUP BY site, dst)"""
FULL = f"""{INLINKS}, fullp AS (SELECT p.*, coalesce(i.inlinks, 0) AS inlinks, i.raw_inlinks, s.final_url LIKE 'https:%' AS https_site, s.limit_reached,
    CASE WHEN p.title IS NULL THEN 0 ELSE {px_sql('p.title', 20)} END AS title_px FROM site_pages p LEFT JOIN inl i USING (site, url) JOIN sites s USING (site))"""
_IDX = "NOT noindex AND coalesce(canonical, url) = url"
_LIVE = "is_html AND status = 200 AND "
PAGE_RULES = {
    "blocked-by-robots": ("status = -1", "NULL"),
    "page-failed": ("status = 0", "error"),
    "page-4xx": ("status BETWEEN 400 AND 499", "'HTTP ' || status || ' · linked from ' || coalesce(raw_inlinks, 0) || ' page(s)'"),
    "page-5xx": ("status >= 500", "'HTTP ' || status"),
    "sitemap-non-200": ("in_sitemap AND status <> 200 AND status > 0", "'HTTP ' || status"),
    "missing-title": (_LIVE + "coalesce(title, '') = ''", "NULL"),
    "title-too-long": (_LIVE + "title_px > 600", "length(title) || ' chars · ~' || title_px || 'px'"),
    "title-too-short": (_LIVE + "title_px <= 600 AND length(title) BETWEEN 1 AND 29", "length(title) || ' chars: “' || title || '”'"),
    "missing-description": (_LIVE + "coalesce(meta_description, '') = ''", "NULL"),
    "description-too-long": (_LIVE + "length(meta_description) > 160", "length(meta_description) || ' chars'"),
    "description-too-short": (_LIVE + "length(meta_description) BETWEEN 1 AND 69", "length(meta_description) || ' chars'"),
    "missing-h1": (_LIVE + "h1_count = 0", "NULL"),
    "multiple-h1": (_LIVE + "h1_count > 1", "h1_count || ' H1 tags'"),
    "missing-alt": (_LIVE + "images_missing_alt > 0", "images_missing_alt || ' of ' || images || ' images'"),
    "slow-page": (_LIVE + "ttfb_ms > 1000", "ttfb_ms || ' ms'"),
    "large-page": (_LIVE + "html_bytes > 1048576", "printf('%.1f', html_bytes / 1048576) || ' MB'"),
    "low-word-count": (_LIVE + _IDX + " AND word_count < 200", "word_count || ' words'"),
    "missing-viewport": (_LIVE + "NOT viewport", "NULL"),
    "mixed-content": (_LIVE + "mixed_content > 0", "mixed_content || ' insecure resource(s)'"),
    "http-internal-links": (_LIVE + "http_internal_links > 0 AND https_site", "http_internal_links || ' link(s)'"),
    "missing-canonical": (_LIVE + "canonical IS NULL", "NULL"),
    "non-canonical": (_LIVE + "canonical <> url", "'→ ' || canonical"),
    "noindex-page": (_LIVE + "noindex", "NULL"),
    "noindex-in-sitemap": (_LIVE + "noindex AND in_sitemap", "NULL"),
    "deep-page": (_LIVE + "depth > 3", "depth || ' clicks'"),
    "nofollow-internal": (_LIVE + "nofollow_internal > 0", "nofollow_internal || ' link(s)'"),
    "dead-end": (_LIVE + "internal_links = 0", "NULL"),
    "missing-lang": (_LIVE + "lang IS NULL", "NULL"),
    "missing-og": (_LIVE + "NOT open_graph", "NULL"),
    "no-structured-data": (_LIVE + "NOT structured_data", "NULL"),
    "uncompressed": (_LIVE + "NOT compressed AND html_bytes > 1024", "NULL"),
    "single-inlink": (_LIVE + _IDX + " AND depth > 0 AND inlinks = 1", "NULL"),
    "orphan-page": (_LIVE + "NOT limit_reached AND in_sitemap AND depth <> 0 AND inlinks = 0", "NULL"),
}
PAGE_ISSUES = " UNION ALL ".join(f"SELECT site, '{k}' AS issue, url, CAST({d} AS VARCHAR) AS detail FROM fullp WHERE {c}" for k, (c, d) in PAGE_RULES.items())
DUPLICATES = " UNION ALL ".join(
    f"""SELECT site, '{issue}' AS issue, url, {detail} AS detail FROM (SELECT site, url, {col} AS v, count(*) OVER (PARTITION BY site, {col}) AS n
        FROM site_pages WHERE {_LIVE}{_IDX} AND {cond}) q WHERE n > 1"""
    for issue, col, cond, detail in [
        ("duplicate-title", "title", "title <> ''", "'“' || substr(v, 1, 70) || '” used on ' || n || ' pages'"),
        ("duplicate-description", "meta_description", "meta_description <> ''", "'Shared by ' || n || ' pages'"),
        ("duplicate-content", "content_hash", "word_count >= 50", "'Same content as ' || (n - 1) || ' other page(s)'"),
    ])
TARGETS = f"""{EDGES}, targets AS (SELECT e.site, e.src, e.dst, coalesce(p.status, c.status) AS status FROM edges e
    LEFT JOIN site_pages p ON p.site = e.site AND p.url = e.dst LEFT JOIN link_checks c ON c.site = e.site AND c.url = e.dst
    WHERE coalesce(p.status, c.status) <> -1)"""


def per_source_sql(issue: str, rows: str, n: int, detail: str) -> str:
    return f"""SELECT site, '{issue}' AS issue, src AS url, {detail} AS detail FROM (SELECT site, src, count(*) AS n,
        list_slice(list(item ORDER BY item), 1, {n}) AS e FROM ({rows}) r GROUP BY site, src) g"""


BROKEN = per_source_sql("broken-internal-links", """SELECT site, src, dst || ' (' || CASE WHEN status = 0 THEN 'failed' ELSE CAST(status AS VARCHAR) END || ')'
    AS item FROM targets WHERE status = 0 OR status BETWEEN 400 AND 599""", 3, "n || ' broken: ' || array_to_string(e, ', ') || CASE WHEN n > 3 THEN '…' ELSE '' END")
TO_REDIRECT = per_source_sql("links-to-redirect", "SELECT site, src, dst AS item FROM targets WHERE status BETWEEN 300 AND 399", 1, "n || ' link(s), e.g. ' || e[1]")
IMAGES = per_source_sql("broken-images", """SELECT i.site, i.src, i.dst AS item FROM image_links i JOIN link_checks c ON c.site = i.site AND c.url = i.dst
    WHERE c.status IN (404, 410) OR c.status >= 500 OR (c.status = 0 AND c.code = 'ENOTFOUND')""", 2, "n || ' broken: ' || array_to_string(e, ', ')")
EXTERNALS = per_source_sql("broken-external-links", """SELECT site, src, dst || ' (' || CASE WHEN status = 0 THEN code ELSE CAST(status AS VARCHAR) END || ')' AS item FROM
    (SELECT e.site, e.src, e.dst, c.status, c.code, row_number() OVER (PARTITION BY e.site, e.dst ORDER BY e.ord, e.src) AS rn FROM external_links e
     JOIN link_checks c ON c.site = e.site AND c.url = e.dst WHERE c.status IN (404, 410) OR (c.status >= 500 AND c.status <> 503)
     OR (c.status = 0 AND c.code IN ('ENOTFOUND', 'ECONNREFUSED', 'CERT_HAS_EXPIRED', 'ERR_TLS_CERT_ALTNAME_INVALID', 'DEPTH_ZERO_SELF_SIGNED_CERT'))) f
    """, 2, "n || ' broken: ' || array_to_string(e, ', ')")
CANONICAL = """SELECT p.site, 'canonical-to-broken' AS issue, p.url, p.canonical || ' (' || CASE WHEN t.status = 0 THEN 'failed' ELSE CAST(t.status AS VARCHAR) END || ')'
    AS detail FROM site_pages p JOIN site_pages t ON t.site = p.site AND t.url = p.canonical
    WHERE p.is_html AND p.status = 200 AND p.canonical <> p.url AND (t.status = 0 OR t.status BETWEEN 400 AND 599)"""
WALK = """walk AS (SELECT site, url AS start, redirect_to AS nxt, [url] AS chain, false AS looped FROM site_pages WHERE status BETWEEN 300 AND 399 AND redirect_to IS NOT NULL
    UNION ALL SELECT w.site, w.start, CASE WHEN list_contains(w.chain, w.nxt) THEN NULL WHEN p.status BETWEEN 300 AND 399 THEN p.redirect_to END,
    CASE WHEN list_contains(w.chain, w.nxt) THEN w.chain ELSE list_append(w.chain, w.nxt) END, list_contains(w.chain, w.nxt)
    FROM walk w LEFT JOIN site_pages p ON p.site = w.site AND p.url = w.nxt WHERE w.nxt IS NOT NULL)"""
WALKED = "walked AS (SELECT site, start AS url, chain, looped FROM walk WHERE nxt IS NULL)"
REDIRECTS = """SELECT site, CASE WHEN looped THEN 'redirect-loop' ELSE 'redirect-chain' END AS issue, url,
    CASE WHEN looped THEN array_to_string(chain, ' → ') ELSE (len(chain) - 1) || ' hops: ' || array_to_string(chain, ' → ') END AS detail
    FROM walked WHERE looped OR len(chain) > 2"""
CHECKED = """checked AS (SELECT s.*, CASE WHEN s.final_url NOT LIKE 'https:%' THEN 'n/a' WHEN h.status BETWEEN 300 AND 399 AND h.location LIKE 'https:%' THEN 'redirects'
    WHEN h.status = 200 THEN 'no-redirect' ELSE 'unreachable' END AS https_redirect,
    CASE WHEN NOT s.apex_or_www THEN 'n/a' WHEN a.status = 200 THEN 'duplicate' WHEN a.status BETWEEN 300 AND 399 THEN 'redirects' ELSE 'unreachable' END AS host_canonicalization,
    CASE WHEN s.final_url LIKE 'https:%' THEN h.url END AS http_url, a.url AS alternate_host_url
    FROM sites s LEFT JOIN host_probes h ON h.site = s.site AND h.kind = 'http' LEFT JOIN host_probes a ON a.site = s.site AND a.kind = 'alt_host')"""
SITE_ISSUES = """SELECT site, 'site-not-https' AS issue, final_url AS url, NULL AS detail FROM checked WHERE final_url NOT LIKE 'https:%'
    UNION ALL SELECT site, 'http-not-redirected', http_url, 'Returns 200 over HTTP' FROM checked WHERE https_redirect = 'no-redirect'
    UNION ALL SELECT site, 'host-duplicate', alternate_host_url, 'Also serves content; should redirect to ' || regexp_extract(final_url, '//([^/]*)', 1) FROM checked
    WHERE host_canonicalization = 'duplicate' UNION ALL SELECT site, 'no-robots', final_url || 'robots.txt', NULL FROM checked WHERE NOT robots_found
    UNION ALL SELECT site, 'no-sitemap', final_url || 'sitemap.xml', NULL FROM checked WHERE NOT sitemap_found"""
SEV = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.SEVERITY.items())
ALL = f"""WITH RECURSIVE {FULL}, targets AS (SELECT e.site, e.src, e.dst, coalesce(p.status, c.status) AS status FROM edges e
    LEFT JOIN site_pages p ON p.site = e.site AND p.url = e.dst LEFT JOIN link_checks c ON c.site = e.site AND c.url = e.dst
    WHERE coalesce(p.status, c.status) <> -1), {WALK}, {WALKED}, {CHECKED}, findings AS (SELECT *, CASE issue {SEV} END AS severity FROM (
    {SITE_ISSUES} UNION ALL {PAGE_ISSUES} UNION ALL {DUPLICATES} UNION ALL {REDIRECTS} UNION ALL {CANONICAL} UNION ALL {BROKEN} UNION ALL {TO_REDIRECT}
    UNION ALL {IMAGES} UNION ALL {EXTERNALS}) u) """


RESOURCES = ["broken-external-links", "broken-images"]


def pages_and_findings(spark, d, ids=None, detail=True):
    """Pages, and findings of all rules or some.

    What feeds many rules is written once, as a crawl would have landed it, with the columns that rules read: images and external links, of which the
    link checks are made, then edges and pages. Each is deleted when the last findings on it are written, before the next is made. Edges and inlinks are
    made only for rules that count them, or examples.
    """
    wanted = set(audit.SEVERITY) if ids is None else set(ids)
    sites = graph.host_checks(landed(spark, d, "sites"), landed(spark, d, "host_probes"))
    images, externals = (cut_lineage(landed(spark, d, n).select("site", "src", "dst", "k"), lean=True) for n in ("image_links", "external_links"))
    checks = cut_lineage(over(spark, "link_checks", image_links=images, external_links=externals), lean=True)
    edges, pages, parts = landed(spark, d, "site_links").select("site", "src", "dst"), pages_of(spark, d), []
    for issue, read in zip(RESOURCES, (externals, images), strict=True):
        if issue in wanted:
            parts.append(audit.find_issues(pages, edges, images, externals, checks, sites, {issue}, detail))
        forget(read)
    counted = bool(wanted & {"single-inlink", "orphan-page"}) or (detail and "page-4xx" in wanted)
    if counted or detail:
        edges = cut_lineage(edges.distinct(), lean=True)
    if counted:
        inlinks = cut_lineage(audit.inlink_counts(edges, distinct=True), lean=True)
        pages = cut_lineage(pages.join(inlinks, ["site", "url"], "left").withColumn("inlinks", F.coalesce("inlinks", F.lit(0))), lean=True)
        forget(inlinks)
    else:
        pages = cut_lineage(pages.withColumns({"inlinks": F.lit(0), "raw_inlinks": F.lit(None).cast("int")}), lean=True)
    parts.append(audit.find_issues(pages, edges, images, externals, checks, sites, wanted - set(RESOURCES), detail))
    forget(edges)
    forget(checks)
    return pages, reduce(DataFrame.unionByName, parts)


def findings_of(spark, d, ids=None, detail=True):
    return pages_and_findings(spark, d, ids, detail)[1]


@query("page_issues", f"WITH {FULL} {PAGE_ISSUES}")
def page_issues(spark, d):
    return audit.page_issues(full_pages(spark, d))


@query("duplicate_issues", DUPLICATES)
def duplicate_issues(spark, d):
    return audit.duplicate_issues(pages_of(spark, d))


@query("broken_internal_links", f"WITH {TARGETS} {BROKEN}")
def broken_internal_links(spark, d):
    return audit.broken_link_issues(audit.faulty_targets(edges_of(spark, d), pages_of(spark, d), landed(spark, d, "link_checks")))


@query("links_to_redirect", f"WITH {TARGETS} {TO_REDIRECT}")
def links_to_redirect(spark, d):
    return audit.redirect_link_issues(audit.faulty_targets(edges_of(spark, d), pages_of(spark, d), landed(spark, d, "link_checks")))


@query("broken_images", IMAGES)
def broken_images(spark, d):
    return audit.broken_image_issues(landed(spark, d, "image_links"), landed(spark, d, "link_checks"))


@query("broken_externals", EXTERNALS)
def broken_externals(spark, d):
    return audit.broken_external_issues(landed(spark, d, "external_links"), landed(spark, d, "link_checks"))


@query("canonical_to_broken", CANONICAL)
def canonical_to_broken(spark, d):
    return audit.canonical_issues(pages_of(spark, d))


@query("redirect_chains", f"WITH RECURSIVE {WALK}, {WALKED} SELECT site, url, array_to_string(chain, ' ') AS chain, looped AS is_loop, len(chain) - 1 AS hops FROM walked")
def redirect_chains(spark, d):
    return graph.redirect_chains(pages_of(spark, d)).withColumn("chain", F.array_join("chain", " "))


@query("host_checks", f"WITH {CHECKED} SELECT * FROM checked")
def host_checks(spark, d):
    return graph.host_checks(landed(spark, d, "sites"), landed(spark, d, "host_probes"))


@query("site_issues", f"WITH {CHECKED} {SITE_ISSUES}")
def site_issues(spark, d):
    return audit.site_issues(graph.host_checks(landed(spark, d, "sites"), landed(spark, d, "host_probes")))


@query("issue_rollup", ALL + """SELECT site, issue, severity, count(*) AS count, array_to_string(list(url ORDER BY url, detail NULLS FIRST), ' ') AS urls
    FROM findings GROUP BY site, issue, severity""")
def issue_rollup(spark, d):
    # what a finding says isn't asked for, and of two on one page both are listed
    return audit.issue_rollup(findings_of(spark, d, detail=False)).withColumn("urls", F.array_join(F.transform("urls", lambda u: u["url"]), " "))


@query("severity_totals", ALL + """SELECT site, severity, CAST(sum(n) AS BIGINT) AS findings, count(*) AS issue_types FROM
    (SELECT site, issue, severity, count(*) AS n FROM findings GROUP BY ALL) g GROUP BY site, severity""")
def severity_totals(spark, d):
    counts = findings_of(spark, d, detail=False).groupBy("site", "issue", "severity").agg(F.count("*").alias("count"))
    return audit.severity_totals(counts)


@query("health_score", ALL + """SELECT p.site, CAST(CASE WHEN count(*) FILTER (WHERE p.status <> -1) = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE p.status <> -1 AND d.url IS NULL)
    / count(*) FILTER (WHERE p.status <> -1) * 100 + 0.5) END AS INT) AS health_score FROM site_pages p
    LEFT JOIN (SELECT DISTINCT site, url FROM findings WHERE severity = 'error') d ON d.site = p.site AND d.url = p.url GROUP BY p.site""")
def health_score(spark, d):
    errors = {issue for issue, severity in audit.SEVERITY.items() if severity == "error"}
    return audit.health_score(*pages_and_findings(spark, d, errors, detail=False))


@query("pages_with_issues", ALL + """SELECT p.site, p.url, coalesce(f.issues, '') AS issues FROM site_pages p LEFT JOIN
    (SELECT site, url, array_to_string(list(issue ORDER BY issue), ' ') AS issues FROM findings GROUP BY site, url) f ON f.site = p.site AND f.url = p.url""")
def pages_with_issues(spark, d):
    return audit.pages_with_issues(*pages_and_findings(spark, d, detail=False)).select("site", "url", F.array_join("issues", " ").alias("issues"))


@query("issue_list", ALL + """SELECT site, issue, severity, count, CAST(row_number() OVER (PARTITION BY site ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
    count DESC, issue) AS INT) AS place FROM (SELECT site, issue, severity, count(*) AS count FROM findings GROUP BY ALL) g""")
def issue_list(spark, d):
    counts = findings_of(spark, d, detail=False).groupBy("site", "issue", "severity").agg(F.count("*").alias("count"))
    return ranking.top_n(counts, ["site"], audit.issue_order(), len(audit.SEVERITY), "place")


@query("inlinks", f"WITH {INLINKS} SELECT * FROM inl")
def inlinks(spark, d):
    return audit.inlink_counts(edges_of(spark, d))


# Depth by rounds: every (page, clicks) pair is kept once, the least is the depth. Redirects add no click.
DEPTHS = """WITH RECURSIVE g AS (SELECT DISTINCT site, src, dst, 1 AS w FROM site_links UNION SELECT site, url, redirect_to, 0 FROM site_pages WHERE redirect_to IS NOT NULL),
    reach AS (SELECT site, url, 0 AS depth FROM site_pages WHERE ord = 0 UNION SELECT r.site, g.dst, r.depth + g.w FROM reach r JOIN g ON g.site = r.site AND g.src = r.url
    WHERE r.depth + g.w <= 14), depths AS (SELECT site, url, min(depth) AS depth FROM reach GROUP BY site, url) """


@query("click_depth", DEPTHS + "SELECT site, url, depth FROM depths")
def click_depth(spark, d):
    pages = landed(spark, d, "site_pages").select("site", "url", "redirect_to", "ord")
    return graph.click_depths(pages.where("ord = 0"), graph.graph_edges(landed(spark, d, "site_links"), pages))


@query("orphan_pages", f"WITH {FULL} SELECT site, url FROM fullp WHERE {PAGE_RULES['orphan-page'][0]}")
def orphan_pages(spark, d):
    return graph.orphans(full_pages(spark, d)).select("site", "url")


@query("not_crawled", """SELECT DISTINCT e.site, e.dst AS url FROM (SELECT site, dst FROM external_links UNION SELECT site, dst FROM site_links) e
    LEFT JOIN site_pages p ON p.site = e.site AND p.url = e.dst WHERE p.url IS NULL""")
def not_crawled(spark, d):
    links = landed(spark, d, "site_links").select("site", "dst").union(landed(spark, d, "external_links").select("site", "dst"))
    pages = landed(spark, d, "site_pages")
    return graph.not_crawled(links, pages.where("in_sitemap").select("site", F.col("url").alias("loc")), pages)


@query("status_distribution", """SELECT site, bucket, CAST(sum(n) AS BIGINT) AS pages FROM (SELECT site, CASE WHEN status = -1 THEN 'Blocked' WHEN status = 0 THEN 'Failed'
    ELSE CAST(status // 100 AS VARCHAR) || 'xx' END AS bucket, 1 AS n FROM site_pages UNION ALL SELECT DISTINCT site, k, 0 FROM site_pages,
    (SELECT unnest(['2xx', '3xx', '4xx', '5xx', 'Failed', 'Blocked']) AS k)) u GROUP BY site, bucket""")
def status_distribution(spark, d):
    return audit.status_distribution(landed(spark, d, "site_pages"))


@query("depth_distribution", """SELECT site, CASE WHEN depth >= 5 THEN '5+' ELSE CAST(depth AS VARCHAR) END AS bucket, count(*) AS pages FROM site_pages
    WHERE is_html AND status = 200 AND depth >= 0 GROUP BY 1, 2""")
def depth_distribution(spark, d):
    return audit.depth_distribution(landed(spark, d, "site_pages"))


@query("crawl_stats", """SELECT site, count(*) AS crawled, count(*) FILTER (WHERE is_html) AS html, count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS redirects,
    count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (WHERE status >= 500) AS server_errors,
    count(*) FILTER (WHERE status = 0) AS failed, count(*) FILTER (WHERE status = -1) AS blocked, count(*) FILTER (WHERE status = 200 AND NOT is_html) AS non_html,
    CAST(coalesce(floor(sum(ttfb_ms) FILTER (WHERE status > 0) / count(*) FILTER (WHERE status > 0) + 0.5), 0) AS BIGINT) AS avg_ttfb_ms,
    CAST(coalesce(sum(html_bytes) FILTER (WHERE is_html), 0) AS BIGINT) AS total_html_bytes FROM site_pages GROUP BY site""")
def crawl_stats(spark, d):
    return audit.crawl_stats(landed(spark, d, "site_pages"))


@query("link_counters", """WITH l AS (SELECT site, src, dst, nofollow, true AS internal FROM site_links UNION ALL SELECT site, src, dst, false, false FROM external_links)
    SELECT site, src, count(DISTINCT dst) FILTER (WHERE internal) AS internal_links, count(*) FILTER (WHERE NOT internal) AS external_links,
    count(*) FILTER (WHERE internal AND nofollow) AS nofollow_internal, CAST(0 AS BIGINT) AS http_internal_links FROM l GROUP BY site, src""")
def link_counters(spark, d):
    inner = landed(spark, d, "site_links").select("site", "src", "dst", "nofollow")
    outer = landed(spark, d, "external_links").select("site", "src", "dst", F.lit(False).alias("nofollow"))
    return audit.link_counters(inner.unionByName(outer).withColumn("internal", ur.same_site(F.col("src"), F.col("dst"))))


@query("page_limit", """SELECT site, url, CAST(position AS INT) AS position FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY depth, ord, url) AS position
    FROM site_pages) q WHERE position <= 40""")
def page_limit(spark, d):
    return audit.page_limit(landed(spark, d, "site_pages").select("site", "url", "depth", "ord"), 40).select("site", "url", "position")


@query("check_sources", """SELECT site, dst, src, status FROM (SELECT e.site, e.dst, e.src, c.status, row_number() OVER (PARTITION BY e.site, e.dst ORDER BY e.ord, e.src) AS rn
    FROM external_links e JOIN link_checks c ON c.site = e.site AND c.url = e.dst) q WHERE rn <= 2""")
def check_sources(spark, d):
    return audit.check_sources(landed(spark, d, "external_links"), landed(spark, d, "link_checks"), 2).select("site", "dst", "src", "status")


@query("external_check_list", """SELECT site, dst, CAST(row_number() OVER (PARTITION BY site ORDER BY ord, dst) AS INT) AS position FROM (SELECT site, dst, min(ord) AS ord,
    row_number() OVER (PARTITION BY site, regexp_extract(dst, '//([^/]*)', 1) ORDER BY min(ord), dst) AS rn FROM external_links GROUP BY site, dst) q """)
def external_check_list(spark, d):
    return audit.external_check_list(landed(spark, d, "external_links")).select("site", "dst", "position")


@query("unchecked_resources", """SELECT site, dst, CAST(position AS INT) AS position FROM (SELECT site, dst, row_number() OVER (PARTITION BY site ORDER BY min(ord), dst) AS position
    FROM image_links GROUP BY site, dst) q""")
def unchecked_resources(spark, d):
    images = landed(spark, d, "image_links")
    files = landed(spark, d, "site_links").where(ur.is_resource(F.col("dst")))
    return audit.unchecked_resources(files, images, landed(spark, d, "site_pages")).select("site", "dst", "position")


@query("audit_deadlines", """SELECT site, url, CAST(ttfb_ms + html_bytes - least(70000.0, html_bytes / 4) AS DOUBLE) AS crawl_until,
    CAST(ttfb_ms + html_bytes - least(25000.0, html_bytes / 10) AS DOUBLE) AS check_until FROM site_pages WHERE html_bytes > 0""")
def audit_deadlines(spark, d):
    pages = landed(spark, d, "site_pages").where("html_bytes > 0")
    return pages.select("site", "url", audit.audit_deadlines(F.col("ttfb_ms"), F.col("html_bytes")).alias("t")).select("site", "url", "t.*")


@query("page_table_filter", """SELECT site, url FROM site_pages WHERE lower(concat_ws(' ', url, title)) LIKE '%widget%' AND (status = 0 OR status >= 400)""")
def page_table_filter(spark, d):
    return audit.filter_pages(landed(spark, d, "site_pages"), "Widget", "error").select("site", "url")


@query("external_errors", """SELECT site, url, status, status IN (401, 403, 429, 999) AS bot_blocked FROM link_checks WHERE status = 0 OR status >= 400""")
def external_errors(spark, d):
    return audit.external_view(landed(spark, d, "link_checks"), errors_only=True).select("site", "url", "status", "bot_blocked")


@query("link_checker", """SELECT l.site, l.src, l.dst AS href, c.status, coalesce(c.status IN (0, 404, 410) OR c.status >= 500, false) AS broken FROM external_links l
    LEFT JOIN link_checks c ON c.site = l.site AND c.url = l.dst WHERE coalesce(c.status IN (0, 404, 410) OR c.status >= 500, false)""")
def link_checker(spark, d):
    links = landed(spark, d, "external_links").select("site", "src", F.col("dst").alias("href"))
    checks = landed(spark, d, "link_checks").select("site", "url", "status", F.col("code").alias("error"))
    return audit.filter_links(audit.check_links(links, checks).withColumns({"internal": F.lit(False), "nofollow": F.lit(False)}), "broken").select("site", "src", "href", "status", "broken")


ROBOTS = """SELECT site, base, k, '# file' || chr(10) || 'Sitemap: ' || base || '/map.xml' || chr(10) || 'User-agent: Googlebot' || chr(10) || 'User-agent: bingbot' || chr(10)
    || 'Disallow: /p/' || CAST(k % 10 AS STRING) || chr(10) || 'Allow: /p/' || CAST(k % 10 AS STRING) || '1' || chr(10) || 'Disalow: /typo' || chr(10) || 'Crawl-delay: ' || CAST(k % 4 AS STRING)
    || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /p/*' || CAST(k % 7 AS STRING) || '$' || chr(10) || 'Disallow:' || chr(10) AS text
    FROM (SELECT 's' || CAST(s_suppkey AS STRING) AS site, 'https://s' || CAST(s_suppkey AS STRING) || '.example.com' AS base, s_suppkey AS k FROM supplier) f"""


def robots_of(spark, d):
    return derive(spark, d, ROBOTS).withColumn("fetched", F.col("k") % 9 != 0)


@query("robots_verdict", f"""WITH r AS (SELECT site, CAST(k % 10 AS VARCHAR) AS a, CAST(k % 7 AS VARCHAR) AS b, k % 9 <> 0 AS ok FROM ({ROBOTS}) f)
    SELECT p.site, p.url, CASE WHEN ok THEN NOT starts_with(path, '/p/' || a) OR starts_with(path, '/p/' || a || '1') END AS googlebot,
    CASE WHEN ok THEN NOT starts_with(path, '/p/' || a) OR starts_with(path, '/p/' || a || '1') END AS bingbot,
    CASE WHEN ok THEN NOT (starts_with(path, '/p/') AND ends_with(path, b)) END AS other_bots
    FROM (SELECT site, url, regexp_extract(url, '//[^/]*(.*)$', 1) AS path FROM site_pages) p JOIN r ON r.site = p.site""")
def robots_verdict(spark, d):
    return robots.robots_access(landed(spark, d, "site_pages").select("site", "url"), robots_of(spark, d))


@query("robots_lines", f"""SELECT site, CAST(i AS INT) AS line, key, value, CAST(group_no AS BIGINT) AS group_no FROM
    (SELECT *, sum(CASE WHEN key = 'user-agent' AND prev IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY i) AS group_no FROM (SELECT *, lag(key) OVER (PARTITION BY site ORDER BY i) AS prev FROM (SELECT site, i, lower(trim(split_part(l, ':', 1))) AS key, trim(substr(l, strpos(l, ':') + 1)) AS value FROM
    (SELECT site, unnest(string_split(text, chr(10))) AS l, unnest(range(1, 20)) AS i FROM ({ROBOTS}) f) x WHERE l LIKE '%:%' AND l NOT LIKE 'Sitemap%' AND l NOT LIKE 'Disalow:%') y) w) z
    WHERE NOT (key = 'disallow' AND value = '')""")
def robots_lines(spark, d):
    rules = robots.robots_rules(robots.robots_lines(robots_of(spark, d)))
    return rules.select("site", "line", "key", "value", F.col("group_no").cast("bigint").alias("group_no"))


@query("robots_summary", f"SELECT site, base || '/map.xml' AS sitemaps, CAST(1 AS BIGINT) AS invalid_lines FROM ({ROBOTS}) f")
def robots_summary(spark, d):
    return robots.robots_summary(robots.robots_lines(robots_of(spark, d))).withColumn("sitemaps", F.array_join("sitemaps", " "))


# Sitemaps: an index per site names one file per group of ten pages; each file lists its pages.
def sitemap_files(spark, d):
    """Files and roots. The files come of one pass over the pages and are written once, as they would have been landed; the roots are among them."""
    pages = landed(spark, d, "site_pages").where("in_sitemap").withColumn("grp", F.floor(F.col("ord") / 10))
    base = F.concat(F.lit("https://"), "site", F.lit(".example.com/"))
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("?a=1&amp;b=2</loc><lastmod>2024-01-"), F.lpad((F.col("ord") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    files = pages.groupBy("site", "grp").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("body"))
    leaf = cut_lineage(files.select("site", F.concat(base, F.lit("m"), F.col("grp").cast("string"), F.lit(".xml")).alias("sitemap"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("text")))
    child = F.concat(F.lit("<sitemap><loc><![CDATA["), "sitemap", F.lit("]]></loc></sitemap>"))
    roots = leaf.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(child)), "").alias("body"))
    root = cut_lineage(roots.select("site", F.concat(base, F.lit("index.xml")).alias("sitemap"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("text")))
    return leaf.unionByName(root), root.select("site", "sitemap", F.lit(0).alias("ord"))


def listed_urls(spark, d):
    """URLs of all sitemaps. Entries are read in every round of the expansion, so the files are parsed once."""
    files, roots = sitemap_files(spark, d)
    entries = cut_lineage(responses.parse_sitemaps(files))
    return graph.collect_sitemap_urls(graph.expand_sitemaps(roots, entries), entries)


@query("sitemap_urls", """SELECT site, url || '?a=1&b=2' AS loc, '2024-01-' || lpad(CAST(ord % 28 + 1 AS VARCHAR), 2, '0') AS lastmod FROM site_pages WHERE in_sitemap""")
def sitemap_urls(spark, d):
    return listed_urls(spark, d).select("site", "loc", "lastmod")


@query("sitemap_summary", """SELECT site, count(*) AS url_count, max('2024-01-' || lpad(CAST(ord % 28 + 1 AS VARCHAR), 2, '0')) AS latest_lastmod, false AS partial FROM site_pages
    WHERE in_sitemap GROUP BY site""")
def sitemap_summary(spark, d):
    return graph.sitemap_summary(listed_urls(spark, d)).drop("sample")


@query("issues_export", ALL + """SELECT site, severity, issue, url, CASE WHEN regexp_matches(coalesce(detail, ''), '^[=+\\-@\t\r]') THEN '''' ELSE '' END || coalesce(detail, '') AS detail FROM
    (SELECT *, row_number() OVER (PARTITION BY site, issue ORDER BY url, detail NULLS FIRST) AS rn FROM findings) q""")
def issues_export(spark, d):
    return sinks.csv_safe(sinks.findings_export(findings_of(spark, d)))


@query("concurrent_jobs", """SELECT user_id, CAST(max(run) AS BIGINT) AS peak FROM (SELECT user_id, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, delta, event_id ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('signup', 'view', 'click') THEN 1 ELSE -1 END AS delta FROM events) e) q GROUP BY user_id""")
def concurrent_jobs(spark, d):
    events = derive(spark, d, "SELECT user_id, ts, CASE WHEN event_type IN ('signup', 'view', 'click') THEN 1 ELSE -1 END AS delta FROM events")
    return ranking.peak_running_sum(events, ["user_id"], "ts", "delta", slice_seconds=86400)


@query("page_of_table", """SELECT site, url, CAST(position AS BIGINT) AS position FROM (SELECT site, url, row_number() OVER (ORDER BY word_count DESC, url) - 1 AS position FROM site_pages) q
    WHERE position BETWEEN 100 AND 149""")
def page_of_table(spark, d):
    pages = landed(spark, d, "site_pages").select("site", "url", "word_count")
    return ranking.page_of(pages, -F.col("word_count"), "url", 3, 50).select("site", "url", F.col("position").cast("bigint").alias("position"))
