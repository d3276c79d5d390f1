"""Link-graph operators: click depth, redirect chains, crawl planning, sitemap expansion, orphans."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sitegrain.functions import urls as ur
from sitegrain.operators.ranking import fan_out, hot_keys, spread
from sitegrain.session import append, bucketed, cut_lineage, forget


def graph_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Weighted edges: a link costs one click, a redirect none. A pair may occur more than once; its least weight counts."""
    clicks = links.select("site", "src", "dst", F.lit(1).alias("w"))
    hops = pages.where(F.col("redirect_to").isNotNull()).select("site", F.col("url").alias("src"), F.col("redirect_to").alias("dst"), F.lit(0).alias("w"))
    return clicks.unionByName(hops)


def behind_redirects(edges: DataFrame, buckets: int | None = None) -> DataFrame | None:
    """``(site, url, chain)``: of each redirecting page the pages of its walk, itself first, in buckets by (site, url); None without redirects."""
    walks = redirect_chains(edges.where("w = 0").select("site", F.col("src").alias("url"), F.lit(301).alias("status"), F.col("dst").alias("redirect_to")))
    return None if walks.isEmpty() else bucketed(walks.select("site", "url", "chain"), "site", "url", buckets=buckets)


def walked_on(pages: DataFrame, walks: DataFrame | None) -> DataFrame:
    """Pages with those that their redirects lead to; a page without a redirect stays as it is."""
    if walks is None:
        return pages
    others = [c for c in pages.columns if c not in ("site", "url")]
    return pages.join(walks.hint("shuffle_hash"), ["site", "url"], "left").select("site", F.explode(F.coalesce("chain", F.array("url"))).alias("url"), *others)


def click_depths(starts: DataFrame, edges: DataFrame, rows_per_part: int = 1_000_000) -> DataFrame:
    """Fewest clicks from a start page, ``(site, url, depth)``; unreachable pages have no row.

    ``starts(site, url)`` may carry a ``depth`` of its own. The pages of a level are those that a click from the level before reaches, with all
    pages of their redirect walks, as a redirect costs nothing, and that no earlier level has. Edges by (site, src), walks and settled pages by
    (site, url) lie in as many buckets: a level shuffles only what it reaches and appends it, and none of the tables is sorted for it. The
    level's pages and what is settled are hashed, bucket by bucket, so there are enough buckets for none to have many more than ``rows_per_part``
    links. A hub's edges are dealt over several parts, so no task holds all links of one page.
    """
    depth = F.col("depth") if "depth" in starts.columns else F.lit(0)
    begin, clicks, counted = starts.select("site", "url", depth.alias("depth")), edges.where("w <> 0").select("site", "src", "dst"), Observation()
    hot = hot_keys(clicks.observe(counted, F.count("*").alias("rows")), ["site", "src"], rows_per_part)
    hot = None if hot is None else cut_lineage(hot)
    n = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.get["rows"] // rows_per_part))
    walks = behind_redirects(edges, n)
    begin = cut_lineage(walked_on(begin, walks).groupBy("site", "url").agg(F.min("depth").cast("int").alias("depth")))
    by = ["site", "src"] if hot is None else ["site", "src", "_part"]
    laid = bucketed(clicks if hot is None else spread(clicks, hot, ["site", "src"], ["dst"]), *by, buckets=n)
    levels = sorted(r["depth"] for r in begin.select("depth").distinct().collect())  # a few distinct numbers
    if not levels:
        return begin
    settled = bucketed(begin.where(F.col("depth") == levels[0]), "site", "url", buckets=n)
    level, rows = levels.pop(0), 1
    while rows or levels:
        front = settled.where(F.col("depth") == level).select("site", F.col("url").alias("src"))
        front = front if hot is None else fan_out(front, hot, ["site", "src"])
        found = front.hint("shuffle_hash").join(laid, by).select("site", F.col("dst").alias("url"))
        if walks is not None:
            found = walked_on(found.repartition(n, "site", "url").distinct(), walks)
        level += 1
        if not rows:
            level = levels[0]
        if levels and levels[0] == level:
            found = found.unionByName(begin.where(F.col("depth") == level).select("site", "url"))
            levels.pop(0)
        seen = Observation()
        fresh = found.repartition(n, "site", "url").distinct().join(settled.select("site", "url").hint("shuffle_hash"), ["site", "url"], "left_anti")
        fresh = fresh.withColumn("depth", F.lit(level).cast("int"))
        settled = append(settled, fresh.observe(seen, F.count("*").alias("rows")), dealt=True)
        rows = seen.get["rows"]
    forget(laid)
    if walks is not None:
        forget(walks)
    return settled


def redirect_chains(pages: DataFrame) -> DataFrame:
    """Redirect walk of every 3xx page to its end: ``chain``, ``hops``, ``is_loop``.

    Paths are doubled (1, 2, 4, ... steps) until none grows, each on the redirecting pages only. A path ends at a page that doesn't redirect or
    at the first node it has met before. A walk of n nodes takes about log2(n) rounds.
    """
    step = pages.where(F.col("status").between(300, 399) & F.col("redirect_to").isNotNull()).select(
        "site", "url", F.array("redirect_to").alias("path")
    )

    def ended(walks: DataFrame, last: Column) -> DataFrame:
        """Paths cut behind their first repeat; ``chain`` is what comes before it."""
        nodes = walks.withColumn("path", F.concat(F.array("url"), F.col("path")))
        # as long as nothing repeats, a path and its distinct nodes are the same
        pairs = F.filter(F.arrays_zip(F.col("path").alias("p"), F.array_distinct("path").alias("d"), F.sequence(F.lit(1), F.size("path")).alias("i")), lambda z: ~z["p"].eqNullSafe(z["d"]))
        nodes = nodes.withColumn("at", F.get(pairs, F.lit(0))["i"])
        chain = F.when(F.col("at").isNotNull(), F.slice("path", F.lit(1), F.col("at") - 1)).otherwise(F.col("path"))
        path = F.slice("path", F.lit(2), F.coalesce("at", F.size("path")) - 1)
        return nodes.select("site", "url", path.alias("path"), chain.alias("chain"), F.col("at").isNotNull().alias("is_loop"), (last | F.col("at").isNotNull()).alias("ended"))

    walked = cut_lineage(ended(step, F.lit(False)))
    while not walked.where("NOT ended").isEmpty():
        # rows that are landed twice are one way on, so a round makes no more rows than it has walks
        onward = walked.select("site", F.col("url").alias("_last"), F.col("path").alias("_more"), F.col("ended").alias("_ended")).distinct()
        grown = walked.where("NOT ended").withColumn("_last", F.element_at("path", -1)).join(onward, ["site", "_last"], "left")
        more = F.coalesce("_more", F.array().cast("array<string>"))
        grown = ended(grown.select("site", "url", F.concat("path", more).alias("path"), F.coalesce("_ended", F.lit(True)).alias("_ended")), F.col("_ended"))
        before, walked = walked, cut_lineage(grown.unionByName(walked.where("ended")))
        forget(before)
    return walked.select("site", "url", "chain", "is_loop").withColumn("hops", F.size("chain") - 1)


def crawl_plan(starts: DataFrame, links: DataFrame, pages: DataFrame, sitemap: DataFrame, max_pages: int) -> DataFrame:
    """Pages a crawl with a page limit would fetch, in order: by depth, then first seen, sitemap-only pages last.

    ``links`` needs ``nofollow``, ``page_nofollow``, ``src_allowed`` and ``ord``. Links that are nofollow, come from a
    nofollow or disallowed page, point at a file or leave the site are not followed; redirects keep the depth of their
    source. Sitemap URLs no link leads to start at depth 99.
    """
    followed = links.where(
        ~F.col("nofollow") & ~F.col("page_nofollow") & F.col("src_allowed")
        & ~ur.is_resource(F.col("dst")) & ur.same_site(F.col("src"), F.col("dst"))
    )
    listed = sitemap.select("site", F.col("loc").alias("url")).distinct()
    seeds = starts.select("site", "url", F.lit(0).alias("depth")).unionByName(listed.withColumn("depth", F.lit(99)))
    depths = click_depths(seeds, graph_edges(followed, pages))
    seen_at = followed.groupBy("site", F.col("dst").alias("url")).agg(F.min("ord").alias("ord"))
    queue = depths.join(seen_at, ["site", "url"], "left").withColumn("ord", F.coalesce("ord", F.lit(-1)))
    order = Window.partitionBy("site").orderBy("depth", "ord", "url")
    return queue.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_pages)


def expand_sitemaps(roots: DataFrame, entries: DataFrame, max_sitemaps: int | None = None) -> DataFrame:
    """Sitemaps read breadth-first from the roots through index files: all of them, or the first ``max_sitemaps`` per site.

    ``roots(site, sitemap, ord)``; ``entries(site, sitemap, kind, loc, ord)`` as parsed. Returns ``(site, sitemap, seq, partial)``;
    ``partial`` tells that sitemaps of the site were left out.
    """
    seen = cut_lineage(roots.groupBy("site", "sitemap").agg(F.min(F.struct(F.lit(0).alias("level"), F.lit(0).alias("parent"), "ord")).alias("at")))
    seen = number_sitemaps(seen, max_sitemaps)
    children = entries.where("kind = 'index'").select("site", F.col("sitemap").alias("from"), F.col("loc").alias("sitemap"), "ord")
    for level in count(1):  # ends with the deepest index: each round adds only sitemaps not seen before
        front = seen.where(F.col("at.level") == level - 1).select("site", F.col("sitemap").alias("from"), "seq")
        fresh = (
            front.join(children, ["site", "from"])
            .groupBy("site", "sitemap")
            .agg(F.min(F.struct(F.lit(level).alias("level"), F.col("seq").alias("parent"), "ord")).alias("at"))
            .join(seen.select("site", "sitemap"), ["site", "sitemap"], "left_anti")
        )
        grown = cut_lineage(number_sitemaps(seen.drop("seq").unionByName(fresh, allowMissingColumns=True), max_sitemaps))
        if grown.where(F.col("at.level") == level).isEmpty():
            forget(grown)
            break
        forget(seen)
        seen = grown
    return seen.select("site", "sitemap", "seq", "partial")


def number_sitemaps(seen: DataFrame, max_sitemaps: int | None) -> DataFrame:
    order = Window.partitionBy("site").orderBy("at", "sitemap")
    placed = seen.withColumn("seq", F.row_number().over(order))
    if max_sitemaps is None:
        return placed.withColumn("partial", F.lit(False))
    cut = F.max((F.col("seq") > max_sitemaps) | F.coalesce(F.col("partial"), F.lit(False))) if "partial" in seen.columns else F.max(F.col("seq") > max_sitemaps)
    return placed.withColumn("partial", cut.over(Window.partitionBy("site"))).where(F.col("seq") <= max_sitemaps)


def collect_sitemap_urls(expanded: DataFrame, entries: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Distinct page URLs of the sitemaps that were read, in reading order; all, or the first ``max_urls`` per site.

    ``partial`` tells that sitemaps or URLs of the site were left out.
    """
    sites = expanded.groupBy("site").agg(F.max("partial").alias("_cut"))
    read = expanded.drop("partial").join(sites, "site").join(entries.where("kind = 'urlset'"), ["site", "sitemap"])
    first = read.groupBy("site", "loc").agg(F.min(F.struct("seq", "ord", "lastmod")).alias("at"), F.max("_cut").alias("partial"))
    order = Window.partitionBy("site").orderBy("at.seq", "at.ord", "loc")
    kept = first.withColumn("position", F.row_number().over(order))
    if max_urls is not None:
        totals = first.groupBy("site").agg(F.count("*").alias("_total"))
        kept = kept.where(F.col("position") <= max_urls).join(totals, "site").withColumn("partial", F.col("partial") | (F.col("_total") > max_urls))
    return kept.select("site", "loc", F.col("at.lastmod").alias("lastmod"), "position", "partial")


def sitemap_summary(urls: DataFrame) -> DataFrame:
    """URL count, newest valid lastmod as written, first ten URLs and the partial flag per site."""
    when = F.try_to_timestamp("lastmod")
    return urls.groupBy("site").agg(
        F.count("*").alias("url_count"),
        F.max_by("lastmod", when).alias("latest_lastmod"),
        F.array_sort(F.collect_list(F.when(F.col("position") <= 10, F.struct("position", "loc")))).alias("_s"),
        F.max("partial").alias("partial"),
    ).withColumn("sample", F.transform("_s", lambda s: s["loc"])).drop("_s")


def not_crawled(links: DataFrame, sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """URLs that a link or sitemap names but no page row covers."""
    named = links.select("site", F.col("dst").alias("url")).union(sitemap.select("site", F.col("loc").alias("url"))).distinct()
    return named.join(pages.select("site", "url"), ["site", "url"], "left_anti")


def orphans(pages: DataFrame) -> DataFrame:
    """Sitemap pages without inlinks on sites whose crawl was complete."""
    return pages.where(
        ~F.col("limit_reached") & F.col("in_sitemap") & (F.col("depth") != 0) & (F.col("inlinks") == 0) & F.col("is_html") & (F.col("status") == 200)
    )


def host_checks(sites: DataFrame, probes: DataFrame) -> DataFrame:
    """Redirect state of the http twin and of the www/apex twin, per site."""
    redirect = F.col("status").between(300, 399)
    http = F.when(redirect & F.coalesce(F.col("location"), F.lit("")).startswith("https:"), "redirects").when(F.col("status") == 200, "no-redirect").otherwise("unreachable")
    alt = F.when(F.col("status") == 200, "duplicate").when(redirect, "redirects").otherwise("unreachable")
    found = probes.groupBy("site").agg(
        F.max(F.when(F.col("kind") == "http", http)).alias("_http"), F.max(F.when(F.col("kind") == "alt_host", alt)).alias("_alt"),
        F.max(F.when(F.col("kind") == "http", F.col("url"))).alias("http_url"),
        F.max(F.when(F.col("kind") == "alt_host", F.col("url"))).alias("alternate_host_url"),
    )
    https = F.col("final_url").startswith("https:")
    apex = F.col("apex_or_www")
    return sites.join(found, "site", "left").select(
        *[sites[c] for c in sites.columns],
        F.when(https, F.coalesce("_http", F.lit("unreachable"))).otherwise("n/a").alias("https_redirect"),
        F.when(apex, F.coalesce("_alt", F.lit("unreachable"))).otherwise("n/a").alias("host_canonicalization"),
        F.when(https, F.col("http_url")).alias("http_url"), "alternate_host_url",
    )
