"""Queries and operators that must read all rows and whole texts."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sitegrain.operators import extract, graph, tech
from sitegrain.plans import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_client_rendered_reads_pages(spark, tables):
    shell = '<html><body><div id="root"></div><script src="/a.js"></script></body></html>'
    heavy = "<p>few words<script>" + "x" * 30_001 + "</script>"
    pages = [(1, shell), (2, heavy), (3, "<p>plain"), (4, shell.replace("<body>", "<body>" + "<p>ÄÖ ü.</p>" * 200)), (5, "<p>x" + "<script src='/s.js'></script>" * 8), (6, "<noscript>needs JavaScript</noscript>é")]
    d = tables(pages=([(i, f"https://e.com/{i}", h) for i, h in pages], "page_id long, url string, html string"))
    assert {r.page_id: r.shell for r in QUERIES["client_rendered_pages"](spark, d).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}
    assert QUERIES["client_rendered_pages"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()


def test_suggestions_of_whole_texts(spark, tables):
    texts = [(0, 'one "two" drei\nvier  ünf'), (1, "a < b & c"), (2, "[x] {y} z"), (3, ""), (4, None), (5, "single"), (None, "u v w")]
    d = tables(documents=(texts, "doc_id long, text string"))
    got = {r.doc_id: r.suggestions for r in QUERIES["json_suggestions_whole"](spark, d).collect()}
    assert got == {0: ["one", '"two"', "drei\nvier", "ünf"], 1: ["a", "<", "b", "&", "c"], 2: ["[x]", "{y}", "z"], 3: [], 4: [], 5: ["single"], None: ["u", "v", "w"]}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = QUERIES["json_suggestions_whole"](spark, SMALL)
    assert whole.count() == docs.count()
    plain = docs.where("doc_id % 3 <> 0").select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n"))
    assert whole.join(plain, "doc_id").where(F.size("suggestions") != F.col("n")).count() == 0


def test_intent_of_whole_turns(spark, tables):
    turns = [(1, 0, "Über uns: how to do it"), (1, 1, "42 shoes, best price, buy now"), (1, 200, "日本語"), (2, 0, "x vs y"), (3, 0, None)]
    d = tables(conversations=([(*t[:2], "user", t[2]) for t in turns], "conv_id long, turn int, role string, text string"))
    got = {(r.conv_id, r.turn): (r.intent, r.grp) for r in QUERIES["intent_group_turns"](spark, d).collect()}
    assert got[1, 0][1] == "Questions" and got[1, 1][0] == "Transactional" and got[1, 200] == ("Informational", "Related") and got[2, 0][1] == "Comparisons"
    assert len(got) == 5
    assert QUERIES["intent_group_turns"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/conversations.parquet").count()


def test_long_pages_are_read_whole(spark):
    same = "word " * 40_000
    page = lambda end: f"<main>{same}{end}</main>" + "".join(f"<img src='http://x.com/{i}.png'>" for i in range(120))
    rows = spark.createDataFrame([("https://e.com/1", page("one")), ("https://e.com/2", page("two"))], "url string, html string")
    a, b = extract.extract_pages(rows).orderBy("url").collect()
    assert a.main_text.endswith(" one") and len(a.main_text) == 200_003 and a.content_hash != b.content_hash and len(a.mixed_content) == 120
    late = spark.createDataFrame([(1, "<p>" + "x " * 800_000 + '<script id="__NEXT_DATA__">', {}, None, [])], "id long, html string, headers map<string,string>, generator string, scripts array<string>")
    assert [r.name for r in tech.detect_technologies(late, "id").collect()] == [r.name for r in tech.detect_technologies(late.withColumn("html", F.lit('<script id="__NEXT_DATA__">')), "id").collect()] == ["Next.js"]


def test_redirects_are_walked_to_their_end(spark):
    rows = [("r", f"m{i}", 301, f"m{(i + 1) % 15}") for i in range(15)] + [("r", f"l{i}", 302, f"l{i + 1}") for i in range(100)] + [("r", "in", 301, "m3"), ("r", "s", 301, "s"), ("q", "l5", 301, "x"), ("r", "ok", 200, "l0")]
    rows += [("r", "d0", 301, "d1"), ("r", "d1", 301, "d2"), ("r", "d1", 301, "d2"), ("r", "b", 301, "c"), ("r", "c", 301, "b")]
    walks = graph.redirect_chains(spark.createDataFrame(rows, "site string, url string, status int, redirect_to string")).collect()
    got = {(r.site, r.url): (r.chain, r.hops, r.is_loop) for r in walks}
    assert len(walks) == len(rows) - 1
    assert got["r", "m2"] == ([f"m{(i + 2) % 15}" for i in range(15)], 14, True) and got["r", "in"] == (["in", *(f"m{(i + 3) % 15}" for i in range(15))], 15, True)
    assert got["r", "l0"] == ([f"l{i}" for i in range(101)], 100, False) and got["r", "l99"][1:] == (1, False) and got["q", "l5"] == (["l5", "x"], 1, False)
    assert got["r", "s"] == (["s"], 0, True) and got["r", "d0"] == (["d0", "d1", "d2"], 2, False) and got["r", "b"] == (["b", "c"], 1, True)
    assert graph.redirect_chains(spark.createDataFrame([], "site string, url string, status int, redirect_to string")).count() == 0
