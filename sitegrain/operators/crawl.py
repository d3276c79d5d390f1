"""One audit from landed responses: facts of each page by field extraction, one table of edges, and all rules over them.

A page is scanned once, for the fields that rules need. Its links and images become one edge table; edges and pages are written
bucketed by site and target, so inlinks, link statuses, images and external links are all joined in place: of the many link rules none
shuffles an edge again. What concerns a page's own links alone is counted in its row, before anything is exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import text as tx
from sitegrain.functions import urls as ur
from sitegrain.operators import audit, extract, fields
from sitegrain.session import bucketed, cut_lineage

#: What the rules need of a page.
WANTED = ["title", "meta_description", "meta_robots", "h1", "canonical", "lang", "viewport", "open_graph", "json_ld", "microdata_types", "links", "images", "mixed_content", "word_count", "content_hash"]
#: Columns of a response that the rules read, and what they are, in SQL, where a landed table lacks them.
RESPONSE = {
    "status": "200", "error": "CAST(NULL AS STRING)", "redirect_to": "CAST(NULL AS STRING)", "ttfb_ms": "CAST(NULL AS INT)", "compressed": "CAST(NULL AS BOOLEAN)", "depth": "CAST(NULL AS INT)",
    "robots_header": "CAST(NULL AS STRING)", "content_type": "'text/html'",
}


@dataclass
class Crawl:
    """What an audit joins: pages by (site, url), and distinct edges by (site, dst)."""

    pages: DataFrame
    internal: DataFrame
    images: DataFrame
    external: DataFrame


def page_facts(responses: DataFrame, ended: bool = False) -> DataFrame:
    """The responses (url, html and any of ``RESPONSE``) with the fields that rules need; fragments of addresses are cut off. ``ended`` as in ``fields.extract``."""
    rows = responses.withColumns({n: F.expr(c) for n, c in RESPONSE.items() if n not in responses.columns})
    rows = rows.withColumns({"html_bytes": F.coalesce(F.octet_length("html"), F.lit(0)), "url": F.regexp_replace("url", "#.*$", "")})
    found = fields.extract(rows.select("url", "html", "html_bytes", *RESPONSE), WANTED, ended=ended)
    return found.withColumn("site", ur.strip_www(ur.host_of(F.col("url"))))


def page_columns(facts: DataFrame) -> DataFrame:
    """The columns of ``audit_pages`` but those that need other pages."""
    links, images = F.col("links"), F.col("images")
    inside = F.filter(links, lambda x: x["internal"])
    size = lambda arr, cond: F.size(F.filter(arr, cond))
    tokens = extract.robots_tokens(F.col("meta_robots"), F.col("robots_header"))
    typed = F.exists("json_ld", lambda j: j["valid"] & (F.size(j["types"]) > 0)) | (F.size("microdata_types") > 0)
    shared = lambda key: F.coalesce(F.element_at("open_graph", F.lit(key)), F.lit("")) != ""
    https = F.col("url").startswith("https:")
    made: dict[str, Column] = {
        "title_px": F.coalesce(tx.pixel_width(F.col("title"), 20), F.lit(0)), "h1_count": F.size("h1"), "h1": F.get("h1", F.lit(0)), "noindex": extract.is_noindex(tokens),
        "viewport": F.coalesce(F.col("viewport"), F.lit("")) != "", "open_graph": shared("og:title") & shared("og:image"), "structured_data": typed,
        "images": F.size(images), "images_missing_alt": size(images, lambda x: x["alt"].isNull()),
        "internal_links": F.size(F.array_distinct(F.transform(inside, lambda x: x["href"]))), "external_links": size(links, lambda x: ~x["internal"]),
        "nofollow_internal": size(inside, lambda x: x["nofollow"]), "http_internal_links": F.when(https, size(inside, lambda x: x["href"].startswith("http:"))).otherwise(0),
        "mixed_content": F.size("mixed_content"), "is_html": audit.is_html_page(F.col("status"), F.col("content_type")),
    }
    return facts.withColumns(made).drop("links", "json_ld", "microdata_types", "robots_header", "meta_robots", "content_type")


def edge_rows(facts: DataFrame) -> DataFrame:
    """site, src, dst, kind (internal, external or image), ord (place in the page): links, and images of the own site."""
    own = F.col("site")
    link = F.transform("links", lambda x, i: F.struct(x["href"].alias("dst"), F.when(x["internal"], "internal").otherwise("external").alias("kind"), i.alias("ord")))
    image = F.transform("images", lambda x, i: F.struct(x["src"].alias("dst"), F.when(ur.strip_www(ur.host_of(x["src"])) == own, "image").alias("kind"), i.alias("ord")))
    rows = facts.select("site", F.col("url").alias("src"), F.explode(F.concat(link, F.filter(image, lambda x: x["kind"].isNotNull()))).alias("e"))
    return rows.select("site", "src", "e.dst", "e.kind", F.col("e.ord").cast("bigint").alias("ord"))


def landed_crawl(responses: DataFrame, sitemap: DataFrame, buckets: int | None = None, ended: bool = False) -> Crawl:
    """Pages with inlinks and sitemap marks, and edges, of landed responses and the locations of sitemaps (site, loc)."""
    facts = cut_lineage(page_facts(responses, ended))
    once = edge_rows(facts).groupBy("site", "dst", "src", "kind").agg(F.min("ord").alias("ord"))
    edges = bucketed(once, "site", "dst", buckets=buckets)
    internal = edges.where("kind = 'internal'").select("site", "src", "dst", "ord")
    marked = audit.mark_sitemap(bucketed(page_columns(facts), "site", "url", buckets=buckets), sitemap)
    counted = marked.join(audit.inlink_counts(internal), ["site", "url"], "left").withColumn("inlinks", F.coalesce("inlinks", F.lit(0)))
    pages = bucketed(counted.drop("raw_inlinks"), "site", "url", buckets=buckets)
    return Crawl(pages, internal, edges.where("kind = 'image'").select("site", "src", "dst", "ord"), edges.where("kind = 'external'").select("site", "src", "dst", "ord"))


def findings(crawl: Crawl, checks: DataFrame, sites: DataFrame, ids: set[str] | None = None) -> DataFrame:
    """site, issue, severity, url, detail of all rules, or some. ``checks`` has the status and code of targets that were not crawled."""
    return audit.find_issues(crawl.pages, crawl.internal, crawl.images, crawl.external, checks, sites, ids)
