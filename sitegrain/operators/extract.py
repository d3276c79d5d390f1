"""Page extraction: a small tag scanner yields flat nodes, DataFrame expressions make the fields."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.functions import text as tx
from sitegrain.functions import urls as ur

NODE_SCHEMA = (
    "array<struct<tag:string,attrs:map<string,string>,text:string,url:string,alt:string,"
    "in_nav:boolean,in_svg:boolean,types:array<string>,error:string>>"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*>|[^<]+|<", re.S
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"[\s\ufeff]+")
_NON_WEB = re.compile(r"(?i)^(javascript|mailto|tel|data|sms|ftp|blob|about|file):|^#|^$")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_HIDDEN = frozenset("script style noscript template svg iframe object canvas".split())
_NAV = frozenset(("nav", "header", "footer"))
_CHROME_ROLES = frozenset(("navigation", "banner", "contentinfo"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_KEEP = _HEADINGS | frozenset("title a img script style link meta base form iframe html audio video source".split())


def absolute(href: str | None, base: str) -> str | None:
    """Browser-style absolute URL without fragment; None for anything that is not a web link."""
    raw = (href or "").strip()
    if _NON_WEB.match(raw):
        return None
    try:
        parts = urlsplit(urljoin(base, re.sub(r"[\t\r\n]", "", raw).replace("\\", "/")))
        host, port = parts.hostname or "", parts.port
        if parts.scheme not in ("http", "https") or not host or " " in host:
            return None
        if not host.isascii():
            host = host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    if ":" in host:
        host = f"[{host}]"
    if port and port != (443 if parts.scheme == "https" else 80):
        host = f"{host}:{port}"
    path = quote(parts.path or "/", safe="!$%&'()*+,-./:;=@[]_|~^")
    query = "?" + quote(parts.query, safe="!$%&()*+,-./:;=?@[]^_`{|}~\\") if parts.query else ""
    return f"{parts.scheme}://{host}{path}{query}"


def schema_types(value: object, depth: int = 0) -> list[str]:
    """Distinct ``@type`` names of a JSON-LD value, @graph first, at most six levels down."""
    found: dict[str, None] = {}
    if depth <= 6 and isinstance(value, list):
        for item in value:
            found.update(dict.fromkeys(schema_types(item, depth + 1)))
    elif depth <= 6 and isinstance(value, dict):
        own = value.get("@type")
        found.update(dict.fromkeys(t for t in (own if isinstance(own, list) else [own]) if isinstance(t, str)))
        for key in sorted(value, key=lambda k: k != "@graph"):
            found.update(dict.fromkeys(schema_types(value[key], depth + 1)))
    return list(found)


def _squeeze(s: str | None) -> str:
    return _SPACES.sub(" ", s or "").strip()


def scan(html: str, page_url: str) -> tuple[list[dict], str, str]:
    """Nodes of interest in document order, all visible text, main text."""
    nodes: list[dict] = []
    base, base_set = page_url, False
    stack: list[str] = []
    marks: list[tuple[bool, bool, bool, bool]] = []  # hidden, nav, chrome, svg
    hidden = nav = chrome = svg = False
    captures: list[tuple[int, dict, list[str]]] = []
    everything: list[str] = []
    outside: list[str] = []
    main: list[str] = []
    main_level, main_seen, body = -1, False, False
    pos, size = 0, len(html)

    def close_to(level: int) -> None:
        nonlocal hidden, nav, chrome, svg, main_level
        hidden, nav, chrome, svg = marks[level]
        del stack[level:], marks[level:]
        if main_level >= level:
            main_level = -1
        while captures and captures[-1][0] >= level:
            _, node, parts = captures.pop()
            node["text"] = _squeeze("".join(parts))

    while pos < size:
        m = _TOKEN.match(html, pos)
        token = m.group(0)
        pos = m.end()
        if not m.group(2):
            if token[0] == "<" and len(token) > 1:
                continue
            data = unescape(token)
            for _, _, parts in captures:
                parts.append(data)
            if not hidden and (clean := data.strip()):
                body = True
                everything.append(clean)
                if main_level >= 0:
                    main.append(clean)
                if not chrome:
                    outside.append(clean)
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for level in range(len(stack) - 1, -1, -1):
                if stack[level] == tag:
                    close_to(level)
                    break
            continue
        attrs: dict[str, str] = {}
        for name, a, b, c in _ATTR.findall(m.group(3)):
            attrs.setdefault(name.lower(), unescape(a or b or c))
        if tag == "a" and "a" in stack:
            close_to(len(stack) - 1 - stack[::-1].index("a"))
        if tag in _HEADINGS and stack and stack[-1] in _HEADINGS:
            close_to(len(stack) - 1)
        if tag not in ("html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"):
            body = True
        if tag == "base" and not base_set and "href" in attrs:
            base, base_set = absolute(attrs["href"], page_url) or page_url, True
        node = None
        if tag in _KEEP or "itemtype" in attrs:
            ref = attrs.get("href") or attrs.get("action") or attrs.get("src")
            if tag == "img":
                ref = attrs.get("src") or attrs.get("data-src") or (attrs.get("srcset") or "").split(" ")[0]
                for _, outer, _ in captures:
                    if outer["tag"] == "a" and outer["alt"] is None and "alt" in attrs:
                        outer["alt"] = _squeeze(attrs["alt"])
            node = {
                "tag": tag, "attrs": list(attrs.items()), "text": None, "url": absolute(ref, base) if ref else None,
                "alt": None, "in_nav": nav or tag in _NAV, "in_svg": svg, "types": None, "error": None,
            }
            nodes.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            raw = html[pos : end.start() if end else size]
            pos = end.end() if end else size
            if node is not None:
                node["text"] = _squeeze(unescape(raw)) if tag == "title" else raw
                if tag == "script" and attrs.get("type", "").lower() == "application/ld+json" and raw.strip():
                    try:
                        node["types"] = schema_types(json.loads(raw))
                    except ValueError as err:
                        node["error"] = str(err)[:160]
            elif tag == "textarea" and not hidden and raw.strip():
                everything.append(unescape(raw).strip())
            if tag == "title" and body and not hidden and raw.strip():
                everything.append(unescape(raw).strip())
            continue
        if tag in _VOID or m.group(3).rstrip().endswith("/") and svg:
            continue
        level = len(stack)
        stack.append(tag)
        marks.append((hidden, nav, chrome, svg))
        role = attrs.get("role")
        hidden = hidden or tag in _HIDDEN
        nav = nav or tag in _NAV
        chrome = chrome or tag in _NAV or tag == "aside" or role in _CHROME_ROLES
        svg = svg or tag == "svg"
        if not main_seen and not hidden and (tag in ("main", "article") or role == "main"):
            main_level, main_seen = level, True
        if node is not None and (tag == "a" or tag in _HEADINGS):
            captures.append((level, node, []))
    if stack:
        close_to(0)
    visible = _squeeze(" ".join(everything))
    return nodes, visible, _squeeze(" ".join(main if main_seen else outside))


def scan_pages(pages: DataFrame, html: str = "html", url: str = "url", text_only: bool = False) -> DataFrame:
    """Adds ``nodes``, ``all_text`` and ``main_text``; with ``text_only`` the node array is left out of the transfer."""
    keep = [f for f in pages.schema.fields if f.name != html]
    out = T.StructType(keep + ([] if text_only else [T.StructField("nodes", T.DataType.fromDDL(NODE_SCHEMA))])
                       + [T.StructField("all_text", T.StringType()), T.StructField("main_text", T.StringType())])
    node_type = pa.list_(pa.struct([
        ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("url", pa.string()),
        ("alt", pa.string()), ("in_nav", pa.bool_()), ("in_svg", pa.bool_()), ("types", pa.list_(pa.string())), ("error", pa.string()),
    ]))
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [scan(h or "", u or "") for h, u in zip(batch[html].to_pylist(), batch[url].to_pylist())]
            columns = [batch[n] for n in names]
            if not text_only:
                columns.append(pa.array([d[0] for d in done], node_type))
            columns += [pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return pages.mapInArrow(run, out)


def _pick(*tags: str, where=None) -> Column:
    cond = (lambda n: n["tag"].isin(*tags)) if where is None else (lambda n: n["tag"].isin(*tags) & where(n))
    return F.filter(F.col("nodes"), cond)


def _attr(node: Column, name: str) -> Column:
    return F.element_at(node["attrs"], F.lit(name))


def _meta(name: str) -> Column:
    return _pick("meta", where=lambda n: F.coalesce(F.lower(_attr(n, "name")) == name, F.lit(False)))


def _meta_value(name: str) -> Column:
    found = _meta(name)
    return F.when(F.size(found) > 0, tx.squeeze(F.coalesce(_attr(F.get(found, F.lit(0)), "content"), F.lit(""))))


def _rel(node: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(_attr(node, "rel"), F.lit(""))), tx.SPACE + "+"), lambda r: r != "")


def _link_rel(*tokens: str, where=None) -> Column:
    def cond(n: Column) -> Column:
        hit = F.arrays_overlap(_rel(n), F.array(*[F.lit(t) for t in tokens]))
        return hit if where is None else hit & where(n)

    return _pick("link", where=cond)


def _has(node: Column, name: str) -> Column:
    return _attr(node, name).isNotNull()


def _social(prefix: str, *keys: str) -> Column:
    """First value per lower-cased key, as a map."""

    def key(n: Column) -> Column:
        return F.lower(F.coalesce(*[_attr(n, k) for k in keys], F.lit("")))

    found = _pick("meta", where=lambda n: key(n).startswith(prefix))
    entries = F.transform(found, lambda n: F.struct(key(n).alias("k"), tx.squeeze(F.coalesce(_attr(n, "content"), F.lit(""))).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(F.filter(entries, lambda e: e["k"] == k), F.lit(0))["v"]))


def page_facts(scanned: DataFrame, url: str = "url") -> DataFrame:
    """All page fields from the node array; every expression is a Column, so unused fields are pruned."""
    page_url = F.col(url)
    https = page_url.startswith("https:")
    titles = _pick("title", where=lambda n: ~n["in_svg"])
    canonicals = _link_rel("canonical")
    headings = F.transform(
        _pick(*sorted(_HEADINGS)),
        lambda n: F.struct(F.substring(n["tag"], 2, 1).cast("int").alias("level"), F.substring(n["text"], 1, 300).alias("text")),
    )
    host = ur.strip_www(ur.host_of(page_url))

    def link(n: Column) -> Column:
        label = F.coalesce(
            F.nullif(n["text"], F.lit("")), F.nullif(tx.squeeze(_attr(n, "aria-label")), F.lit("")), n["alt"], F.lit("")
        )
        return F.struct(
            n["url"].alias("href"),
            F.substring(label, 1, 200).alias("text"),
            _rel(n).alias("rel"),
            (ur.strip_www(ur.host_of(n["url"])) == F.col("_host")).alias("internal"),
            F.arrays_overlap(_rel(n), F.array(F.lit("nofollow"), F.lit("ugc"), F.lit("sponsored"))).alias("nofollow"),
            n["in_nav"].alias("in_nav"),
        )

    def image(n: Column) -> Column:
        return F.struct(
            n["url"].alias("src"),
            F.when(_has(n, "alt"), tx.squeeze(_attr(n, "alt"))).alias("alt"),
            _attr(n, "width").alias("width"), _attr(n, "height").alias("height"), _attr(n, "loading").alias("loading"),
        )

    def form(n: Column) -> Column:
        insecure = F.coalesce(n["url"].startswith("http:"), F.lit(False)) & F.col("_https")
        return F.struct(n["url"].alias("action"), insecure.alias("insecure"))

    insecure_ref = lambda n: F.coalesce(
        F.coalesce(_attr(n, "src"), _attr(n, "href")).rlike(r"(?i)^\s*http://"), F.lit(False)
    ) & ((n["tag"] != "link") | F.array_contains(_rel(n), "stylesheet"))
    mixed = F.transform(
        _pick("img", "script", "iframe", "audio", "video", "source", "link", where=insecure_ref),
        lambda n: F.coalesce(_attr(n, "src"), _attr(n, "href")),
    )
    ld = _pick("script", where=lambda n: n["types"].isNotNull() | n["error"].isNotNull())
    js_type = lambda n: F.lower(F.coalesce(_attr(n, "type"), F.lit("")))
    inline_js = _pick("script", where=lambda n: ~_has(n, "src") & (
        (js_type(n) == "") | js_type(n).contains("javascript") | (js_type(n) == "module")))
    total = lambda arr: F.aggregate(arr, F.lit(0), lambda s, n: s + F.length(n["text"]))
    itemtypes = F.transform(F.filter(F.col("nodes"), lambda n: _has(n, "itemtype")),
                            lambda n: F.element_at(F.split(_attr(n, "itemtype"), "/"), -1))
    http_equiv = _pick("meta", where=lambda n: F.coalesce(F.lower(_attr(n, "http-equiv")) == "content-type", F.lit(False)))
    charset_meta = _pick("meta", where=lambda n: _has(n, "charset"))
    first = lambda arr: F.get(arr, F.lit(0))
    robots = F.concat_ws(", ", F.nullif(_meta_value("robots"), F.lit("")), F.nullif(_meta_value("googlebot"), F.lit("")))
    staged = scanned.withColumn("_host", host).withColumn("_https", https)
    passed = [c for c in scanned.columns if c != "nodes"]
    facts = {
        "title": F.when(F.size(titles) > 0, first(titles)["text"]),
        "title_count": F.size(titles),
        "meta_description": _meta_value("description"),
        "meta_description_count": F.size(_meta("description")),
        "meta_robots": F.nullif(robots, F.lit("")),
        "meta_keywords": _meta_value("keywords"),
        "viewport": _meta_value("viewport"),
        "generator": _meta_value("generator"),
        "canonical": first(canonicals)["url"],
        "canonical_count": F.size(canonicals),
        "base_href": _attr(first(_pick("base", where=lambda n: _has(n, "href"))), "href"),
        "lang": F.nullif(F.trim(_attr(first(_pick("html")), "lang")), F.lit("")),
        "charset": F.coalesce(
            _attr(first(charset_meta), "charset"),
            F.nullif(F.regexp_extract(_attr(first(http_equiv), "content"), r"(?i)charset=([\w-]+)", 1), F.lit("")),
        ),
        "headings": headings,
        "h1": F.transform(F.filter(headings, lambda h: h["level"] == 1), lambda h: h["text"]),
        "links": F.transform(_pick("a", where=lambda n: n["url"].isNotNull()), link),
        "images": F.transform(_pick("img", where=lambda n: n["url"].isNotNull()), image),
        "scripts": F.transform(_pick("script", where=lambda n: n["url"].isNotNull()), lambda n: n["url"]),
        "stylesheets": F.transform(_link_rel("stylesheet", where=lambda n: n["url"].isNotNull()), lambda n: n["url"]),
        "hreflang": F.transform(
            _link_rel("alternate", where=lambda n: _has(n, "hreflang") & n["url"].isNotNull()),
            lambda n: F.struct(F.lower(_attr(n, "hreflang")).alias("lang"), n["url"].alias("href")),
        ),
        "open_graph": _social("og:", "property"),
        "twitter": _social("twitter:", "name", "property"),
        "json_ld": F.transform(ld, lambda n: F.struct(
            F.coalesce(n["types"], F.array().cast("array<string>")).alias("types"), n["error"].isNull().alias("valid"), n["error"].alias("error"))),
        "microdata_types": F.array_distinct(F.filter(itemtypes, lambda t: t != "")),
        "favicon": first(_link_rel("icon", "apple-touch-icon"))["url"],
        "amp_html": first(_link_rel("amphtml"))["url"],
        "mixed_content": F.when(F.col("_https"), F.array_distinct(mixed)).otherwise(F.array().cast("array<string>")),
        "forms": F.transform(_pick("form"), form),
        "inline_script_bytes": total(inline_js),
        "inline_style_bytes": total(_pick("style")),
        "iframes": F.size(_pick("iframe")),
        "word_count": tx.count_words(F.col("all_text")),
        "content_hash": tx.content_hash(F.coalesce(F.nullif(F.col("main_text"), F.lit("")), F.col("all_text"))),
    }
    return staged.select(*passed, *[c.alias(n) for n, c in facts.items()])


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per page with every extracted field; the HTML itself is dropped."""
    return page_facts(scan_pages(pages, html, url), url)


def has_doctype(html: Column) -> Column:
    return F.substring(html, 1, 2000).rlike(r"(?is)^\s*(?:<!--.*?-->\s*)*<!doctype html")


def looks_client_rendered(html: Column, words: Column, inline_js: Column, scripts: Column) -> Column:
    """A near-empty shell that scripts fill in."""
    empty_root = html.rlike(
        r"(?i)<(div|main)\b[^>]*\bid=[\"'](root|app|__next|__nuxt|react-root|svelte|mount|application)[\"'][^>]*>\s*</\1>"
    )
    heavy = (inline_js > 30_000) | (F.size(scripts) >= 8)
    asks = html.rlike(r"(?is)<noscript\b[^>]*>.{0,600}?javascript")
    return (words < 250) & (empty_root | heavy | asks)


def robots_tokens(meta: Column, header: Column) -> Column:
    """Directive tokens of the robots meta tag and header, agent prefixes removed."""
    both = F.lower(F.concat(F.coalesce(meta, F.lit("")), F.lit(","), F.coalesce(header, F.lit(""))))
    return F.transform(F.split(both, "[,;]"), lambda t: F.trim(F.regexp_replace(t, r"^[\w-]+:\s*(?=no|none|all)", "")))


def is_noindex(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(F.lit("noindex"), F.lit("none")))


def is_nofollow(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(F.lit("nofollow"), F.lit("none")))


def noindex_source(meta: Column, header: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return F.when(is_noindex(robots_tokens(meta, nothing)), "meta robots tag").when(
        is_noindex(robots_tokens(nothing, header)), "X-Robots-Tag header"
    )


def indexable(noindex: Column, status: Column, googlebot: Column) -> Column:
    return ~noindex & status.between(200, 299) & F.coalesce(googlebot, F.lit(True))


def rejected(content_type: Column, status: Column) -> Column:
    """Not a page: a content type that is neither html nor xml on a status below 400."""
    return F.coalesce(~content_type.rlike("(?i)html|xml") & (status < 400), F.lit(False))


def security_headers(headers: Column) -> Column:
    pick = lambda k: F.element_at(headers, F.lit(k))
    names = ["strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options",
             "referrer-policy", "permissions-policy"]
    cut = {"content-security-policy", "permissions-policy"}
    return F.struct(*[(F.substring(pick(n), 1, 300) if n in cut else pick(n)).alias(n.replace("-", "_")) for n in names])


def result_preview(title: Column, h1: Column, url: Column, description: Column, main_text: Column) -> Column:
    """Title, description and breadcrumb as a result page would cut them."""
    shown = F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.get(h1, F.lit(0)), F.lit("")), url)
    body = F.coalesce(F.nullif(description, F.lit("")), F.substring(main_text, 1, 300), F.lit(""))
    head = tx.truncate_to_pixels(shown, tx.TITLE_PX, tx.TITLE_LIMIT_PX)
    snippet = tx.truncate_to_pixels(body, tx.SNIPPET_PX, tx.SNIPPET_LIMIT_PX)
    return F.struct(
        head["text"].alias("title"), head["truncated"].alias("title_truncated"),
        snippet["text"].alias("description"), snippet["truncated"].alias("description_truncated"),
        ur.breadcrumb(url).alias("breadcrumb"),
    )


def link_image_counts(facts: DataFrame) -> DataFrame:
    """Link and image totals per page, with the lists cut to what a report shows."""
    links, images = F.col("links"), F.col("images")
    count = lambda arr, cond: F.size(F.filter(arr, cond))
    return facts.withColumns({
        "links_total": F.size(links),
        "links_internal": count(links, lambda x: x["internal"]),
        "links_external": count(links, lambda x: ~x["internal"]),
        "links_nofollow": count(links, lambda x: x["nofollow"]),
        "images_total": F.size(images),
        "images_missing_alt": count(images, lambda x: x["alt"].isNull()),
    }).withColumns({
        "links": F.slice(links, 1, 500), "images": F.slice(images, 1, 200),
        "headings": F.slice("headings", 1, 200), "hreflang": F.slice("hreflang", 1, 100),
    })


def trim_report(report: DataFrame, column: str, *heavy: str) -> DataFrame:
    """Drop heavy arrays from a report struct, e.g. ``links.items``."""
    return report.withColumn(column, F.col(column).dropFields(*heavy))


def link_rows(facts: DataFrame, *keys: str) -> DataFrame:
    """One row per link occurrence, in page order."""
    return facts.select(*keys, F.posexplode("links").alias("pos", "link")).select(*keys, "pos", "link.*")


def unique_links(links: DataFrame, *keys: str) -> DataFrame:
    """One row per page and target: attributes of its first occurrence and how often it occurs."""
    first = F.min_by(F.struct("text", "rel", "internal", "nofollow", "in_nav"), "pos")
    return (
        links.groupBy(*keys, "href")
        .agg(first.alias("f"), F.min("pos").alias("pos"), F.count("*").alias("count"))
        .select(*keys, "href", "pos", "count", "f.*")
    )
