"""Element trees against the standard's own examples and a plain parser's words; fields by the tree against the node scanner."""

import random
from html.parser import HTMLParser

import pytest
from test_extract import HTML

from sitegrain.operators import extract, fields
from sitegrain.operators.page_tree import DEPTH, build, events


def shown(node):
    return node if isinstance(node, str) else f"<{node.tag}>{''.join(map(shown, node.children))}</{node.tag}>"


def body(page):
    return "".join(map(shown, build(page).children[0].children[-1].children))


CASES = {
    # misnested formatting
    "<p>1<b>2<i>3</b>4</i>5</p>": "<p>1<b>2<i>3</i></b><i>4</i>5</p>", "<b>1<p>2</b>3</p>": "<b>1</b><p><b>2</b>3</p>", "<a>1<div>2<a>3</a></div></a>": "<a>1</a><div><a>2</a><a>3</a></div>",
    "<p>a<b>b<p>c</b>d": "<p>a<b>b</b></p><p><b>c</b>d</p>", "<b><i>x</b>y</i>": "<b><i>x</i></b><i>y</i>", "<p>x</b>y": "<p>xy</p>", "<i>a<p>b</p>c</i>d": "<i>a<p>b</p>c</i>d",
    # what a table can't hold stands before it
    "A<table><tr> B</tr> C</table>": "A B C<table><tbody><tr></tr></tbody></table>", "<table><b><tr><td>aaa</td></tr>bbb</table>ccc": "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>",
    "<table><p>x<tr><td>y</table>": "<p>x</p><table><tbody><tr><td>y</td></tr></tbody></table>", "<table><td>a<table>b<tr><td>c</table>d</table>": "<table><tbody><tr><td>ab<table><tbody><tr><td>c</td></tr></tbody></table>d</td></tr></tbody></table>",
    "<i>1<table><td>2</i>3</table>4": "<i>1<table><tbody><tr><td>23</td></tr></tbody></table>4</i>",
    # implied elements
    "<table><tr><td>a<td>b<tr><td>c</table>d": "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>d", "<table><col><caption>c</table>": "<table><colgroup><col></col></colgroup><caption>c</caption></table>",
    "<p>a<p>b<div>c</p>d": "<p>a</p><p>b</p><div>c<p></p>d</div>", "<ul><li>a<li>b</ul>c": "<ul><li>a</li><li>b</li></ul>c", "<ul><li>a<ul><li>b</ul><li>c</ul>": "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>",
    "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>", "<h1>a<h2>b</h3>c": "<h1>a</h1><h2>b</h2>c", "<select><option>a<optgroup><option>b</select>c": "<select><option>a</option><optgroup><option>b</option></optgroup></select>c",
    "<button>a<button>b</button>": "<button>a</button><button>b</button>", "<ruby>a<rt>b<rp>c</ruby>": "<ruby>a<rt>b</rt><rp>c</rp></ruby>", "a<td>b</td></table>c": "abc",
    # raw text and foreign content
    "x<noscript><img src=a></noscript>y": "x<noscript><img src=a></noscript>y", "x<textarea><b>&amp;</TEXTAREA >y": "x<textarea><b>&</textarea>y", "x<script>'</scripty>'</script>y": "x<script>'</scripty>'</script>y",
    "<svg><g/>x<path>y</svg>z": "<svg><g></g>x<path>y</path></svg>z", "<svg><g><p>z": "<svg><g></g></svg><p>z</p>", "<svg><foreignObject><div>a</div></foreignObject></svg>b": "<svg><foreignobject><div>a</div></foreignobject></svg>b",
    "a<!-- <p> -->b<!x>c</>d< e <3": "abcd< e <3", "<p title='>'>x</p><p title=\"y": "<p>x</p><p></p>", "</p>x</p>y</br>": "x<p></p>y<br></br>", "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_tree(page):
    assert body(page) == CASES[page]


def test_head_and_body():
    root = build("<title>t</title><link rel=x><meta name=a>text<title>u</title></body>after<p>")
    assert shown(root) == "<#document><html><head><title>t</title><link></link><meta></meta></head><body>text<title>u</title>after<p></p></body></html></#document>"
    merged = build("<html lang=a><body class=b>x<html dir=c lang=d><body id=e>").children[0]
    assert merged.attributes == {"lang": "a", "dir": "c"} and merged.children[1].attributes == {"class": "b", "id": "e"}


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        self.out += [] if self.off else [data]


def test_no_text_is_lost_in_any_order_of_tags():
    """Random tags; the tree's texts have the letters of a plain parser's, though tables may put some of them earlier."""
    random.seed(8)
    tags = "p b i a div table tr td ul li h1 h2 font nobr button form dl dd em".split()
    for _ in range(1500):
        parts = [random.choice([f"<{(t := random.choice(tags))}>", f"</{t}>", random.choice("xyz")]) for _ in range(random.randrange(30))]
        page = "".join(parts)
        plain = Words()
        plain.feed(page)
        plain.close()
        texts = "".join(d for e, d in events(build(page)) if e is None)
        assert sorted(texts) == sorted("".join(plain.out)), page
        again = shown(build(page))
        assert again.count("<") == 2 * sum(1 for e, d in events(build(page)) if e is not None and d is None)


def test_odd_pages_take_linear_time_and_depth_is_bounded():
    deep = build("<div>" * 20_000 + "x")
    node, depth = deep, 0
    while any(not isinstance(c, str) for c in node.children):
        node, depth = next(c for c in reversed(node.children) if not isinstance(c, str)), depth + 1
    assert depth <= DEPTH + 1
    for page in ("<b><p>" * 3000, "<table>" + "x<i>" * 3000, "<a>" * 5000, "<svg>" * 5000, "<p" * 5000, "<select>" * 5000, "<i>" * 600 + "<div>" * 300 + "</i>" * 100):
        assert build(page) is not None


ROWS = [("https://e.com/d/p?q=1", HTML, 1), ("http://www.e.com/", "<h1>a</h1><a href='/x'><img alt=' pic '>", 2), (None, "<a href='https://e.com/x'>x</a>", 3), ("https://e.com/", None, 4), ("https://e.com/", "", 5)]


def test_fields_equal_those_of_the_node_scanner(spark):
    pages = spark.createDataFrame(ROWS, "url string, html string, n int")
    wanted = [*fields.FIELDS, *fields.MADE]
    old = {r["n"]: r.asDict(True) for r in extract.extract_pages(pages).collect()}
    new = {r["n"]: r.asDict(True) for r in fields.extract(pages, wanted).collect()}
    assert new[3]["links"][0]["internal"] is False  # without an address of its own, where the scanner has null
    new[3]["links"] = old[3]["links"]
    for n in old:
        assert {k: new[n][k] for k in wanted if k != "json_ld"} == {k: old[n][k] for k in wanted if k != "json_ld"}
    assert [(j["types"], j["valid"]) for j in new[1]["json_ld"]] == [(["A", "B", "C", "D"], True), ([], False)]


def test_only_wanted_fields_and_bounded_batches(spark):
    pages = spark.createDataFrame([("https://e.com/", "<title>t</title>" + "x" * 3_000_000, i) for i in range(5)], "url string, html string, title int")
    assert fields.extract(pages, ["lang", "links"]).columns == ["url", "title", "lang", "links"]
    assert [tuple(r) for r in fields.extract(pages.withColumnRenamed("title", "n"), ["title", "word_count"]).orderBy("n").collect()] == [("https://e.com/", i, "t", 1) for i in range(5)]
    assert fields.extract(pages, []).columns == ["url", "title"] and fields.extract(pages, []).count() == 5
    with pytest.raises(ValueError, match="nothing"):
        fields.extract(pages, ["nothing"])


def test_labels_and_lists_are_whole(spark):
    page = "<h2>" + "h" * 900 + "</h2><a href=/x>" + "l" * 900 + "</a>" + "<a href='/y'>y</a>" * 900 + "<noscript><img src=/n.png></noscript>"
    row = fields.extract(spark.createDataFrame([("https://e.com/", page)], "url string, html string"), ["headings", "links", "images"]).first()
    assert len(row["headings"][0]["text"]) == len(row["links"][0]["text"]) == 900 and len(row["links"]) == 901 and row["images"] == []
