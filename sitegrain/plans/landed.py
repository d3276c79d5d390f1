"""Landed tables that the registered queries run on, derived from the given tables.

Each is one SELECT that Spark and an ANSI SQL engine read alike, so both sides of a comparison start from the same rows. Tables
grow with the given ones: every supplier is a site and every order line a link. A site's pages are numbered modulo 150, so that
its links make a dense graph; what a page says comes from a part of its own, over all parts.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from sitegrain.session import balanced

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


# Tables whose rows cost much work each; see ``balanced``.
TEXT_TABLES = ["documents", "pages"]


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


BASE = f"'https://s' || {s('l_suppkey')} || '.example.com'"
PAGE = "base || '/p/' || "

DERIVED: dict[str, str] = {
    # Suppliers are sites, parts are their pages, order lines are links between pages.
    "site_links": f"""SELECT 's' || {s('l_suppkey')} AS site, {BASE} || '/p/' || {s('l_partkey % 150')} AS src,
        {BASE} || '/p/' || {s('l_orderkey % 150')} AS dst, l_orderkey * 10 + l_linenumber AS ord,
        (l_linenumber = 7) AS nofollow FROM lineitem""",
    "site_nodes": f"""SELECT site, base, n, h, {PAGE}{s('n')} AS url,
        CASE WHEN n = 0 THEN 200 WHEN h < 30 THEN 404 WHEN h < 40 THEN 500 WHEN h < 50 THEN 0 WHEN h < 60 THEN -1 WHEN h < 200 THEN 301
             ELSE 200 END AS status
        FROM (SELECT 's' || {s('k')} AS site, 'https://s' || {s('k')} || '.example.com' AS base, n, (k * 7919 + n * 104729) % 1000 AS h
              FROM (SELECT l_suppkey AS k, l_partkey % 150 AS n FROM lineitem UNION SELECT l_suppkey AS k, l_orderkey % 150 AS n FROM lineitem
                    UNION SELECT s_suppkey AS k, 0 AS n FROM supplier) nodes) placed""",
    "site_pages": f"""SELECT site, url, CAST(status AS INT) AS status, CASE WHEN status = 0 THEN 'timeout' END AS error,
        CASE WHEN status = 301 THEN {PAGE}{s('(n * 3 + 1) % 150')} END AS redirect_to, CAST(h % 6 AS INT) AS depth,
        (h % 2 = 0) AS in_sitemap, n AS ord,
        CASE WHEN h % 13 = 0 THEN NULL WHEN h % 7 = 0 THEN p_name || ' made for every home and garden in the country and well beyond it'
             ELSE p_name || ' ' || p_type || ' ' || p_brand END AS title,
        CASE WHEN h % 9 = 0 THEN NULL ELSE 'About ' || p_name || repeat(' and more', CAST(h % 25 AS INT)) END AS meta_description,
        CAST(h % 4 AS INT) AS h1_count, p_name AS h1, CAST(h AS INT) AS word_count,
        CASE WHEN h % 5 = 0 THEN NULL WHEN h % 5 = 1 THEN {PAGE}{s('(n * 7 + 2) % 150')} ELSE url END AS canonical,
        (h % 19 = 0) AS noindex, CASE WHEN h % 8 = 0 THEN NULL ELSE 'en' END AS lang, (h % 6 <> 0) AS viewport, (h % 4 = 0) AS open_graph,
        (h % 3 = 1) AS structured_data, CAST(h % 10 AS INT) AS images, CASE WHEN h % 10 > 6 THEN 2 ELSE 0 END AS images_missing_alt,
        CAST(h % 12 AS INT) AS internal_links, CASE WHEN h % 23 = 0 THEN 3 ELSE 0 END AS nofollow_internal,
        CASE WHEN h % 29 = 0 THEN 1 ELSE 0 END AS http_internal_links, CASE WHEN h % 31 = 0 THEN 2 ELSE 0 END AS mixed_content,
        {s('h % 200')} AS content_hash, CAST(floor(p_retailprice) + (h % 5) * 60 AS INT) AS ttfb_ms, CAST(h * 2000 AS INT) AS html_bytes,
        (h % 3 <> 0) AS compressed, (status = 200 AND h % 11 <> 0) AS is_html
        FROM site_nodes LEFT JOIN part ON p_partkey = (SELECT min(p_partkey) FROM part) + (n + CAST(substr(site, 2) AS BIGINT) * 150) % (SELECT max(p_partkey) - min(p_partkey) + 1 FROM part)""",
    "sites": f"""SELECT 's' || {s('s_suppkey')} AS site,
        CASE WHEN s_suppkey % 10 = 0 THEN 'http' ELSE 'https' END || '://s' || {s('s_suppkey')} || '.example.com/' AS final_url,
        (s_suppkey % 4 = 0) AS limit_reached, (s_suppkey % 6 <> 0) AS robots_found, (s_suppkey % 7 <> 0) AS sitemap_found,
        (s_suppkey % 5 <> 0) AS apex_or_www FROM supplier""",
    "host_probes": f"""SELECT 's' || {s('s_suppkey')} AS site, 'http' AS kind, 'http://s' || {s('s_suppkey')} || '.example.com/' AS url,
        CASE s_suppkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 301 ELSE 0 END AS status,
        CASE WHEN s_suppkey % 3 = 1 THEN 'https://s' || {s('s_suppkey')} || '.example.com/' END AS location FROM supplier
        UNION ALL SELECT 's' || {s('s_suppkey')}, 'alt_host', 'https://www.s' || {s('s_suppkey')} || '.example.com/',
        CASE s_suppkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 301 ELSE 0 END, NULL FROM supplier""",
    "image_links": f"""SELECT site, src, {PAGE.replace('/p/', '/img/')}{s('k')} || '.png' AS dst, min(ord) AS ord, k FROM
        (SELECT 's' || {s('l_suppkey')} AS site, {BASE} AS base, {BASE} || '/p/' || {s('l_partkey % 150')} AS src,
         l_linenumber + (l_partkey % 3) * 10 AS k, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) shown GROUP BY site, src, base, k""",
    "external_links": f"""SELECT site, src, 'https://h' || {s('a')} || '.example.org/d/' || {s('b')} AS dst, min(ord) AS ord, (a * 20 + b) % 9 AS k FROM
        (SELECT 's' || {s('l_suppkey')} AS site, {BASE} || '/p/' || {s('l_partkey % 150')} AS src, l_partkey % 40 AS a, l_orderkey % 20 AS b,
         l_orderkey * 10 + l_linenumber AS ord FROM lineitem) named GROUP BY site, src, a, b""",
    "link_checks": """SELECT DISTINCT site, dst AS url, CASE k % 5 WHEN 0 THEN 404 WHEN 1 THEN 0 WHEN 2 THEN 503 ELSE 200 END AS status,
        CASE WHEN k % 5 = 1 THEN 'ENOTFOUND' END AS code FROM image_links
        UNION ALL SELECT DISTINCT site, dst AS url, CASE k WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 500 WHEN 5 THEN 403
        ELSE 200 END, CASE k WHEN 2 THEN 'ECONNREFUSED' WHEN 3 THEN 'ETIMEDOUT' END FROM external_links""",
    # Customers are domains, orders are days with a popularity rank.
    "rank_history": f"""SELECT 'c' || {s('o_custkey')} || '.example.com' AS domain, CAST(o_orderdate AS DATE) AS date,
        1 + (o_orderkey * 7919 + o_custkey) % 1500000 AS rank FROM orders""",
    "domains": f"""SELECT 'c' || {s('c_custkey')} || CASE c_custkey % 6 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.de' WHEN 2 THEN '.com.br' WHEN 3 THEN '.io'
        ELSE '.example.com' END AS domain, 'c' || {s('c_custkey')} || '.example.com' AS ranked, c_custkey,
        CASE c_custkey % 5 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'fr' WHEN 2 THEN 'pt_BR' WHEN 3 THEN 'xx' END AS lang FROM customer""",
    # Documents are autocomplete lists: their source is the seed, their two-word runs are the suggestions.
    "suggestion_texts": """SELECT doc_id, source AS seed, CASE doc_id % 6 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' WHEN 2 THEN 'duckduckgo' WHEN 3 THEN 'amazon' WHEN 4 THEN 'yandex' ELSE 'youtube' END
        AS engine, text, (doc_id % 7 <> 3) AS ok FROM documents""",
    "search_log": f"""SELECT user_id, event_type AS tool, CASE WHEN event_id % 2 = 0 THEN 'Site ' ELSE 'site ' END || {s('event_id % 60')} AS query,
        ts AS at, event_id FROM events""",
    "posts": f"""SELECT 'd' || {s('doc_id')} AS slug, source, lang, text, n_chars, doc_id, CAST((doc_id * 37) % 900 AS INT) AS day FROM documents""",
}


def parents(sql: str) -> list[str]:
    """Derived tables a statement reads."""
    return [n for n in DERIVED if re.search(rf"\b{n}\b", sql)]


def ordered(sql: str) -> list[str]:
    """All derived tables a statement needs, each after its own inputs."""
    out: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in parents(text):
            if name != own and name not in out:
                visit(DERIVED[name], name)
                out.append(name)

    visit(sql)
    return out


def with_landed(sql: str) -> str:
    """The statement with the derived tables it needs as leading common table expressions."""
    names = ordered(sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({DERIVED[n]})" for n in names)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the lazy reader is kept, so its schema is read once per session."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return balanced(scan) if name in TEXT_TABLES else scan


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame over the files of ``sf_dir``."""
    return derive(spark, sf_dir, f"SELECT * FROM {name}")


def over(spark: SparkSession, name: str, **made: DataFrame) -> DataFrame:
    """A derived table over tables it reads, which were made before."""
    return spark.sql(re.sub(rf"\b({'|'.join(made)})\b", r"{\1}", DERIVED[name]), **made)


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = with_landed(sql)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)
