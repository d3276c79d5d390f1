"""Layout of small pages, and the words of whole pages against a plain parser."""

from html.parser import HTMLParser

import pytest
from conftest import SMALL

from sitegrain.llm.html_text import extract_text, visible_text

CASES = {
    "<p>a  b\n c<p>d<br>e": "a b c\n\nd\ne",
    "<h1>T</h1>x<div>y</div>z": "T\n\nx\ny\nz",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>a<li>b<p>c</ol>": "3. a\n4. b\n\n   c",
    "<table><tr><th>n<th>long head<tr><td>12345<td>x</table>": "n     | long head\n12345 | x",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one</table>": "a | b\n    c\nwide one",
    "<table><caption>C</caption><tr><td><table><tr><td>in</table></table>": "C\nin",
    "<pre> x\n   y </pre>z": " x\n   y\n\nz",
    "<head><title>t</title></head><body>v<script>var a='<p>';</script><style>.h{display:none}</style><b class='k h'>n</b><i hidden>n</i><u style='DISPLAY : none'>n</u>w": "vw",
    "a<!-- x <p> -->b &amp; &eacute;&nbsp;c": "ab & é c",
    "<title>t</title><p>x": "x",
    "a < b <3 <": "a < b <3 <",
    "<a title='>'>x</a><a title=\"y": "x",
    "<b><div>x</div></b>y": "x\ny",
    "<dl><dt>a<dd>b<dt>c<dd>d</dl>": "a\n  b\nc\n  d",
    "<blockquote><p>a<p>b</blockquote>": "  a\n\n  b",
    "<p>" + "İ" * 20 + "</p><script>x</SCRIPT>Hello world<b>bold</b>": "İ" * 20 + "\n\nHello worldbold",
    "": "", "<p> </p>": "", "<textarea>a <b></textarea>c": "a <b>c",
    "<select><option>a<option>b</select>": "a\nb",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert visible_text(page) == CASES[page]


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_words_of_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = extract_text(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        plain = Plain()
        plain.feed(html[r.page_id])
        plain.close()
        words = [w for w in r.text.split() if w not in ("-", "|") and not (w[:-1].isdigit() and w[-1] == ".")]
        assert "".join(words) == "".join(w for w in plain.words if w not in ("-", "|") and not (w[:-1].isdigit() and w[-1] == "."))


def test_odd_rows(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000 + "<ul><li>" * 3000 + "y"
    rows = [(1, None), (2, ""), (3, deep), (4, "<a " * 100_000), (5, "<a '" + "<b \"" * 50_000), (6, "w " * 200_000), (1, "<p>x"), (None, "x")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    got = sorted((r.page_id or 0, r.text is None, len((r.text or "").split())) for r in extract_text(pages).collect())
    assert got[0] == (0, False, 1) and got[1] == (1, False, 1) and got[2] == (1, True, 0) and got[3] == (2, False, 0) and got[-1] == (6, False, 200_000)
    assert "x" in visible_text(deep) and "y" in visible_text(deep)
    assert extract_text(pages.limit(0)).count() == 0
