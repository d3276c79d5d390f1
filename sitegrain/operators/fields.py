"""Page extraction by wanted fields: one pass over each page's element tree, which makes typed columns of just the fields asked for.

Unlike the node array of ``extract``, nothing but the wanted columns leaves the Python worker, and what only other fields need isn't computed
there: links aren't resolved for a title, text isn't joined for links. A worker turns at most ``BATCH_BYTES`` of HTML into rows at a
time (one page at least) and sends these on before it reads further, so memory follows the largest page and not Arrow's rows per batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sitegrain.functions import text as tx
from sitegrain.operators.extract import absolute, schema_types
from sitegrain.operators.page_tree import HEADINGS, Element, build, events

#: Bytes of HTML that a worker holds as trees and rows at a time.
BATCH_BYTES = 4 << 20

# Elements without content of their own, and those around a page's content.
HIDDEN = frozenset("script style noscript template svg iframe object canvas".split())
NAV = frozenset(("nav", "header", "footer"))
CHROME_ROLES = frozenset(("navigation", "banner", "contentinfo"))
MIXED = frozenset("img script iframe audio video source link".split())

LINK = "array<struct<href:string,text:string,rel:array<string>,internal:boolean,nofollow:boolean,in_nav:boolean>>"
IMAGE = "array<struct<src:string,alt:string,width:string,height:string,loading:string>>"
#: Every field and its type.
FIELDS = {
    "title": "string", "title_count": "int", "meta_description": "string", "meta_description_count": "int", "meta_robots": "string", "meta_keywords": "string", "viewport": "string",
    "generator": "string", "canonical": "string", "canonical_count": "int", "base_href": "string", "lang": "string", "charset": "string", "headings": "array<struct<level:int,text:string>>",
    "h1": "array<string>", "links": LINK, "images": IMAGE, "scripts": "array<string>", "stylesheets": "array<string>", "hreflang": "array<struct<lang:string,href:string>>",
    "open_graph": "map<string,string>", "twitter": "map<string,string>", "json_ld": "array<struct<types:array<string>,valid:boolean,error:string>>", "microdata_types": "array<string>",
    "favicon": "string", "amp_html": "string", "mixed_content": "array<string>", "forms": "array<struct<action:string,insecure:boolean>>", "inline_script_bytes": "int",
    "inline_style_bytes": "int", "iframes": "int", "all_text": "string", "main_text": "string",
}
#: Fields that Spark makes of others.
MADE: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "word_count": (("all_text",), lambda: tx.count_words(F.col("all_text"))),
    "content_hash": (("main_text", "all_text"), lambda: tx.content_hash(F.coalesce(F.nullif(F.col("main_text"), F.lit("")), F.col("all_text")))),
}


def squeeze(s: str | None) -> str:
    return " ".join((s or "").replace("﻿", " ").split())


def host(url: str) -> str:
    """Lower-case host without port and one leading www."""
    name = url.partition("://")[2]
    for stop in "/?#":
        name = name.partition(stop)[0]
    name = name.rpartition("@")[2].lower()
    name, colon, port = name.rpartition(":") if name.rpartition(":")[2].isdigit() else (name, "", "")
    return name.removeprefix("www.")


def rel_of(element: Element) -> list[str]:
    return element.attributes.get("rel", "").lower().split()


class Page:
    """Fields of a page, each made when it is asked for."""

    def __init__(self, page: str, url: str, text: bool, links: bool, ended: bool = False):
        self.url, self.https = url, url.startswith("https:")
        self.by_tag: dict[str, list[Element]] = {}
        self.labels: dict[int, str] = {}
        self.navs: set[int] = set()
        self.in_svg: set[int] = set()
        self.typed: list[Element] = []
        self.all_text = self.main_text = ""
        self.walk(build(page, ended), text, links)
        given = next((e.attributes["href"] for e in self.tagged("base") if "href" in e.attributes), None)
        self.base_href = given
        self.base = (absolute(given, url) or url) if given is not None else url

    def walk(self, root: Element, text: bool, links: bool) -> None:
        hidden = nav = chrome = svg = inside = 0
        main: Element | None = None
        found = False
        every: list[str] = []
        kept: list[str] = []
        outside: list[str] = []
        captures: list[tuple[Element, list[str]]] = []
        for element, data in events(root):
            if element is None:
                for _, parts in captures:
                    parts.append(data)
                if text and not hidden and inside and (clean := data.strip()):
                    every.append(clean)
                    if main is not None:
                        kept.append(clean)
                    if not chrome:
                        outside.append(clean)
                continue
            tag, start = element.tag, data is None
            if start:
                self.by_tag.setdefault(tag, []).append(element)
                if nav:
                    self.navs.add(id(element))
                if svg:
                    self.in_svg.add(id(element))
                if element.raw and "itemtype" in element.raw.lower() and "itemtype" in element.attributes:
                    self.typed.append(element)
                if links and (tag == "a" or tag in HEADINGS):
                    captures.append((element, []))
            step = 1 if start else -1
            if tag in HIDDEN:
                hidden += step
                if captures and tag in ("script", "style") and start:
                    captures.append((element, []))  # their text is no label's
                elif captures and captures[-1][0] is element:
                    captures.pop()
            if tag in NAV:
                nav += step
            role = element.attributes.get("role") if element.raw and text else None
            if tag in NAV or tag == "aside" or role in CHROME_ROLES:
                chrome += step
            if tag == "svg":
                svg += step
            if tag == "body":
                inside += step
            if start and not found and not hidden and inside and (tag in ("main", "article") or role == "main"):
                main, found = element, True
            if not start:
                if main is element:
                    main = None
                if captures and captures[-1][0] is element:
                    self.labels[id(element)] = squeeze("".join(captures.pop()[1]))
        self.all_text = squeeze(" ".join(every))
        self.main_text = squeeze(" ".join(kept if found else outside))

    def tagged(self, *tags: str) -> list[Element]:
        if len(tags) == 1:
            return self.by_tag.get(tags[0], [])
        return [e for t in tags for e in self.by_tag.get(t, [])]

    def abs(self, ref: str | None) -> str | None:
        return absolute(ref, self.base) if ref else None

    def metas(self, name: str) -> list[Element]:
        return [e for e in self.tagged("meta") if e.attributes.get("name", "").lower() == name]

    def meta(self, name: str) -> str | None:
        found = self.metas(name)
        return squeeze(found[0].attributes.get("content")) if found else None

    def rel(self, *tokens: str) -> list[Element]:
        return [e for e in self.tagged("link") if not set(tokens).isdisjoint(rel_of(e))]

    def social(self, prefix: str, *keys: str) -> list[tuple[str, str]]:
        out: dict[str, str] = {}
        for e in self.tagged("meta"):
            key = next((e.attributes[k] for k in keys if k in e.attributes), "").lower()
            if key.startswith(prefix):
                out.setdefault(key, squeeze(e.attributes.get("content")))
        return list(out.items())

    def ordered(self, tags: frozenset[str], root: Element) -> Iterator[Element]:
        return (e for e, data in events(root) if e is not None and data is None and e.tag in tags)

    # the fields

    def titles(self) -> list[Element]:
        return [e for e in self.tagged("title") if id(e) not in self.in_svg]

    def title(self):
        found = self.titles()
        return squeeze("".join(c for c in found[0].children if isinstance(c, str))) if found else None

    def title_count(self):
        return len(self.titles())

    def meta_description(self):
        return self.meta("description")

    def meta_description_count(self):
        return len(self.metas("description"))

    def meta_robots(self):
        return ", ".join(x for x in (self.meta("robots"), self.meta("googlebot")) if x) or None

    def meta_keywords(self):
        return self.meta("keywords")

    def viewport(self):
        return self.meta("viewport")

    def generator(self):
        return self.meta("generator")

    def canonical(self):
        found = self.rel("canonical")
        return self.abs(found[0].attributes.get("href")) if found else None

    def canonical_count(self):
        return len(self.rel("canonical"))

    def lang(self):
        return (self.tagged("html")[0].attributes.get("lang") or "").strip(" ") or None

    def charset(self):
        given = next((e.attributes["charset"] for e in self.tagged("meta") if "charset" in e.attributes), None)
        if given is not None:
            return given
        typed = next((e for e in self.tagged("meta") if e.attributes.get("http-equiv", "").lower() == "content-type"), None)
        content = typed.attributes.get("content", "") if typed is not None else ""
        _, found, rest = content.lower().partition("charset=")
        size = next((i for i, c in enumerate(rest) if not (c.isascii() and (c.isalnum() or c in "_-"))), len(rest))
        start = len(content) - len(rest)
        return content[start : start + size] or None if found else None

    def headings(self):
        every = {id(e): e for e in self.tagged(*HEADINGS)}
        return [{"level": int(e.tag[1]), "text": text} for i, text in self.in_order() if (e := every.get(i)) is not None]

    def in_order(self) -> list[tuple[int, str]]:
        """Labels in the order in which their elements begin."""
        places = {id(e): e for t in (*HEADINGS, "a") for e in self.tagged(t)}
        return [(id(e), self.labels.get(id(e), "")) for e, data in events(self.tagged("#document")[0]) if e is not None and data is None and id(e) in places]

    def h1(self):
        return [self.labels.get(id(e), "") for e in self.tagged("h1")]

    def links(self):
        out, own = [], host(self.url)
        for e in self.tagged("a"):
            href = self.abs(e.attributes.get("href"))
            if href is None:
                continue
            rel = rel_of(e)
            label = self.labels.get(id(e)) or squeeze(e.attributes.get("aria-label"))
            if not label:
                label = next((squeeze(i.attributes["alt"]) for i in self.ordered(frozenset(("img",)), e) if "alt" in i.attributes), "")
            out.append({"href": href, "text": label, "rel": rel, "internal": host(href) == own, "nofollow": not {"nofollow", "ugc", "sponsored"}.isdisjoint(rel), "in_nav": id(e) in self.navs})
        return out

    def images(self):
        out = []
        for e in self.tagged("img"):
            a = e.attributes
            src = self.abs(a.get("src") or a.get("data-src") or (a.get("srcset") or "").split(" ")[0])
            if src is not None:
                out.append({"src": src, "alt": squeeze(a["alt"]) if "alt" in a else None, **{k: a.get(k) for k in ("width", "height", "loading")}})
        return out

    def scripts(self):
        return [u for e in self.tagged("script") if (u := self.abs(e.attributes.get("src"))) is not None]

    def stylesheets(self):
        return [u for e in self.rel("stylesheet") if (u := self.abs(e.attributes.get("href"))) is not None]

    def hreflang(self):
        found = [(e.attributes["hreflang"].lower(), self.abs(e.attributes.get("href"))) for e in self.rel("alternate") if "hreflang" in e.attributes]
        return [{"lang": lang, "href": href} for lang, href in found if href is not None]

    def open_graph(self):
        return self.social("og:", "property")

    def twitter(self):
        return self.social("twitter:", "name", "property")

    def json_ld(self):
        out = []
        for e in self.tagged("script"):
            raw = "".join(c for c in e.children if isinstance(c, str))
            if e.attributes.get("type", "").lower() == "application/ld+json" and raw.strip():
                try:
                    out.append({"types": schema_types(json.loads(raw)), "valid": True, "error": None})
                except (ValueError, RecursionError) as err:
                    out.append({"types": [], "valid": False, "error": str(err)[:160]})
        return out

    def microdata_types(self):
        return [t for t in dict.fromkeys(e.attributes["itemtype"].rpartition("/")[2] for e in self.typed) if t]

    def favicon(self):
        found = self.rel("icon", "apple-touch-icon")
        return self.abs(found[0].attributes.get("href")) if found else None

    def amp_html(self):
        found = self.rel("amphtml")
        return self.abs(found[0].attributes.get("href")) if found else None

    def mixed_content(self):
        if not self.https:
            return []
        out: dict[str, None] = {}
        for e in self.ordered(MIXED, self.tagged("#document")[0]):
            ref = e.attributes.get("src", e.attributes.get("href")) or ""
            if ref.strip().lower().startswith("http://") and (e.tag != "link" or "stylesheet" in rel_of(e)):
                out[ref] = None
        return list(out)

    def forms(self):
        found = [self.abs(e.attributes.get("action")) for e in self.tagged("form")]
        return [{"action": u, "insecure": bool(u and u.startswith("http:") and self.https)} for u in found]

    def raw_size(self, *elements: Element) -> int:
        return sum(len(c) for e in elements for c in e.children if isinstance(c, str))

    def inline_script_bytes(self):
        code = lambda kind: not kind or "javascript" in kind or kind == "module"
        return self.raw_size(*(e for e in self.tagged("script") if "src" not in e.attributes and code(e.attributes.get("type", "").lower())))

    def inline_style_bytes(self):
        return self.raw_size(*self.tagged("style"))

    def iframes(self):
        return len(self.tagged("iframe"))


def row_of(page: str | None, url: str | None, wanted: list[str], ended: bool = False) -> list:
    """The wanted fields of a page; a null page is empty, a null address resolves nothing."""
    own = Page(page or "", url or "", not {"all_text", "main_text"}.isdisjoint(wanted), not {"links", "headings", "h1"}.isdisjoint(wanted), ended)
    return [value() if callable(value := getattr(own, name)) else value for name in wanted]


def extract(pages: DataFrame, wanted: list[str], html: str = "html", url: str = "url", ended: bool = False) -> DataFrame:
    """The columns of ``pages`` but the HTML, and the wanted ones of ``FIELDS`` and ``MADE``. Filter pages before: what is left out isn't read.

    With ``ended``, only character references with a semicolon at their end are decoded, not also the old names that browsers read without one.
    """
    unknown = [n for n in wanted if n not in FIELDS and n not in MADE]
    if unknown:
        raise ValueError(f"no such fields: {unknown}")
    made = [n for n in wanted if n in MADE]
    scanned = list(dict.fromkeys([n for n in wanted if n in FIELDS] + [x for n in made for x in MADE[n][0]]))
    keep = [f for f in pages.schema.fields if f.name != html and f.name not in scanned]
    out = T.StructType(keep + [T.StructField(n, T.DataType.fromDDL(FIELDS[n])) for n in scanned])
    kinds = [to_arrow_type(f.dataType) for f in out.fields[len(keep) :]]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                start, size, rows = at, 0, []
                while at < batch.num_rows and (not rows or size < BATCH_BYTES):
                    page = batch[html][at].as_py()
                    size += len(page or "")
                    rows.append(row_of(page, batch[url][at].as_py(), scanned, ended))
                    at += 1
                columns = [batch[n].slice(start, at - start) for n in names]
                columns += [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if scanned else []
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    found = pages.mapInArrow(run, out)
    return found.withColumns({n: MADE[n][1]() for n in made}).select(*names, *wanted)
