import pytest
from pyspark.sql import functions as F

from sitegrain.functions import phrases as ph
from sitegrain.functions import text as tx
from sitegrain.functions import urls as ur
from sitegrain.operators import audit, traffic


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_published_hash_vectors(spark):
    assert value(spark, tx.content_hash(F.lit("a"))) == "e40c292c"
    assert value(spark, tx.content_hash(F.lit("  FooBar "))) == "bf9cf968"

    def fnv(text):
        h = 0x811C9DC5
        raw = text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i:i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    assert value(spark, tx.content_hash(F.lit("smile \U0001F600 é"))) == fnv("smile \U0001F600 é")


def test_tokens_and_widths(spark):
    assert value(spark, tx.tokenize(F.lit("It’s a -well-known- 'Test' №5"))) == ["it's", "a", "well-known", "test", "5"]
    assert value(spark, tx.count_words(F.lit("two words"))) == 2
    wide = value(spark, tx.pixel_width(F.lit("W" * 10), 20))
    thin = value(spark, tx.pixel_width(F.lit("i" * 10), 20))
    assert (wide, thin) == (189, 44)
    cut = value(spark, tx.truncate_to_pixels(F.lit("A very long page title that keeps going and going until it is cut by the engine"), 20, 600))
    assert cut["truncated"] and cut["text"].endswith(" ...")
    assert value(spark, tx.truncate_to_pixels(F.lit("Short"), 20, 600))["text"] == "Short"


def test_sentences_are_counted_as_in_the_plain_pattern(spark):
    import re

    for text in ["One. Two! Three? ", "a. . b.", "no end", "1.5 is x. y", "end.\n\nNext...", "..leading. x"]:
        full = text + " word" * 40
        want = max(1, len(re.findall(r"[^.!?]+[.!?]+(?:\s|$)", full)))
        assert value(spark, tx.readability(F.lit(full)))["sentences"] == want, text
    assert value(spark, tx.readability(F.lit("too short."))) is None


@pytest.mark.parametrize("href,base,want", [
    ("/a b?x=1#f", "https://E.com/d/p", "https://e.com/a%20b?x=1"), ("../x/./y", "https://e.com/a/b/c", "https://e.com/a/x/y"), ("//cdn.com/z", "http://e.com/", "http://cdn.com/z"),
    ("?q=2", "https://e.com/p?q=1", "https://e.com/p?q=2"), ("page", "https://e.com", "https://e.com/page"), ("mailto:a@b.c", "https://e.com/", None), ("#top", "https://e.com/", None),
    ("http://e.com:80/ü", "https://e.com/", "http://e.com/%C3%BC"),
])
def test_resolve_link_in_both_forms(spark, href, base, want):
    from sitegrain.operators.extract import absolute

    assert value(spark, ur.resolve_link(F.lit(href), F.lit(base))) == want
    assert absolute(href, base) == want


def test_url_rules(spark):
    assert value(spark, ur.same_site(F.lit("http://www.e.com:8080/a"), F.lit("https://e.com")))
    assert not value(spark, ur.same_site(F.lit("http://blog.e.com/"), F.lit("https://e.com")))
    assert value(spark, ur.is_resource(F.lit("https://e.com/a/FILE.PDF?x=1")))
    assert not value(spark, ur.is_resource(F.lit("https://e.com/a.pdf/")))
    assert value(spark, ur.parse_url_input(F.lit("Example.com/x#y"))) == "https://example.com/x"
    assert value(spark, ur.parse_url_input(F.lit("localhost"))) is None
    reasons = {"ftp://e.com/": "scheme", "http://u@e.com/": "credentials", "http://e.com:22/": "port", "http://127.0.0.1/": "address", "http://x.local/": "host", "https://e.com/": None}
    for url, want in reasons.items():
        assert value(spark, ur.reject_reason(F.lit(url))) == want
    public = {"::1": False, "::": False, "fc00::1": False, "fd00::1": False, "fe80::1": False, "2606:4700::1111": True, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "2001:db8::1": False,
              "2606:4700:0:0:0:0:0:1": True, "2606:4700:0:0:0:0:1": False, "2606::4700::1": False, "2606::g": False, "::ffff:8.8.8.800": False, "ff02::1": False, "2002::1": False, "nonsense": False}
    rows = spark.createDataFrame([(k,) for k in public], "ip string")
    assert {r["ip"]: r["p"] for r in rows.select("ip", ur.is_public_ipv6(F.col("ip")).alias("p")).collect()} == public
    reasons = {"http://[::1]/": "address", "http://[fd00::1]:8080/x": "address", "https://[2606:4700::1111]/": None, "http://[2606:4700::1111]:22/": "port"}
    assert {r["u"]: r["r"] for r in spark.createDataFrame([(k,) for k in reasons], "u string").select("u", ur.reject_reason(F.col("u")).alias("r")).collect()} == reasons


def test_registrable_domain_by_wildcards_and_exceptions(spark):
    rules = spark.createDataFrame([("com",), ("ck",), ("*.ck",), ("!www.ck",), ("*.kawasaki.jp",), ("!city.kawasaki.jp",), ("jp",), ("Co.UK",)], "suffix string")
    want = {
        "a.b.shop.ck": "b.shop.ck", "shop.ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck", "a.city.kawasaki.jp": "city.kawasaki.jp", "city.kawasaki.jp": "city.kawasaki.jp",
        "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "c.kawasaki.jp": None, "kawasaki.jp": "kawasaki.jp", "a.b.co.uk": "b.co.uk", "a.b.unknown": "b.unknown", "10.0.0.1": None, "localhost": None, "b.com": "b.com",
    }
    hosts = spark.createDataFrame([(h, i) for i, h in enumerate(want)], "host string, rule int")
    assert {r["host"]: r["domain"] for r in ur.with_registrable_domain(hosts, "host", rules).collect()} == want


def test_registrable_domain_with_a_suffix_table(spark):
    hosts = spark.createDataFrame([("a.b.foo.bar",), ("x.co.uk",), ("1.2.3.4",), ("deep.x.github.io",)], "host string")
    suffixes = spark.createDataFrame([("foo.bar",)], "suffix string")
    own = {r["host"]: r["domain"] for r in ur.with_registrable_domain(hosts, "host", suffixes).collect()}
    assert own["a.b.foo.bar"] == "b.foo.bar"
    default = {r["host"]: r["domain"] for r in ur.with_registrable_domain(hosts, "host").collect()}
    assert default == {"a.b.foo.bar": "foo.bar", "x.co.uk": "x.co.uk", "1.2.3.4": None, "deep.x.github.io": "x.github.io"}


def test_phrases(spark):
    assert value(spark, ph.normalize_phrase(F.lit("  C++ & M&S – «Best» 'Tools'. "))) == "c++ m&s best tools"
    assert value(spark, ph.acceptable(F.lit("privacy policy"))) is False
    assert value(spark, ph.acceptable(F.lit("is it down"))) is True
    assert value(spark, ph.acceptable(F.lit("for the win"))) is False
    assert value(spark, ph.title_segments(F.lit("Acme Tool | Fast – Simple? Yes!"))) == ["acme tool", "fast", "simple", "yes"]
    assert value(spark, ph.with_stems(F.lit("is it down right now"))) == ["is it down right now", "is it down", "is it"]
    assert value(spark, ph.brand_of(F.lit("is-it-down"))) == ["is it down", "isitdown"]
    assert value(spark, ph.suggested_at(F.lit("is it down"), F.array(F.lit("x"), F.lit("isitdown.com")))) == 2
    assert value(spark, ph.competitors(F.lit("is it down"), F.array(F.lit("isitdownnow"), F.lit("other"), F.lit("isit")))) == 1
    assert value(spark, ph.stem(F.lit("companies"))) == "company"
    assert value(spark, ph.drop_year(F.lit("best laptops 2025 2026"))) == "best laptops"
    assert [value(spark, ph.intent(F.lit(k))) for k in ("buy shoes", "best shoes", "acme login", "shoe history")] == ["Transactional", "Commercial", "Navigational", "Informational"]
    assert [value(spark, ph.group(F.lit(k))) for k in ("how to tie", "a vs b", "shoes for men", "one two three four", "red shoes")] == ["Questions", "Comparisons", "Prepositions", "Long-tail", "Related"]
    assert len(value(spark, ph.expand_queries(F.lit(" Seed ")))) == 25


def test_volume_estimate_calibration_and_monotony(spark):
    rows = spark.createDataFrame([(p, pos, c) for p in range(1, 20) for pos in (1, 5) for c in (0, 5, 9)], "p int, pos int, c int")
    got = {(r["p"], r["pos"], r["c"]): r["v"] for r in rows.select("*", ph.estimate_volume(F.col("p"), F.col("pos"), F.col("c")).alias("v")).collect()}
    for (p, pos, c), v in got.items():
        assert v >= got.get((p + 1, pos, c), 0)
        assert str(v).rstrip("0").isdigit() and len(str(v).rstrip("0")) == 1
    assert got[(1, 1, 9)] == 10_000_000
    assert [value(spark, ph.volume_level(F.lit(v))) for v in (10_000, 1_000, 999)] == ["High", "Medium", "Low"]


def test_visits_pass_through_the_anchors_and_fall(spark):
    ranks = spark.createDataFrame([(r,) for r in (1, 10, 100, 1000, 10000, 100000, 1000000, 5000000, 0)], "rank int")
    got = {r["rank"]: r["e"] for r in ranks.select("rank", traffic.visit_estimate(F.col("rank")).alias("e")).collect()}
    for rank, visits in traffic.ANCHORS:
        assert got[rank]["mid"] == pytest.approx(visits, rel=1e-9)
    assert got[0] is None and got[5000000]["mid"] < 9e3
    assert (got[1]["factor"], got[1000000]["factor"]) == (2.0, 3.5)
    assert [value(spark, traffic.popularity_tier(F.lit(r))) for r in (0, 100, 101, 10001, 999999)] == ["Unranked", "Top 100", "Top 1K", "Top 100K", "Top 1M"]


def test_deadlines_and_predicates(spark):
    t = value(spark, audit.audit_deadlines(F.lit(0), F.lit(270000)))
    assert (t["crawl_until"], t["check_until"]) == (202500, 245000)
    assert value(spark, audit.audit_deadlines(F.lit(0), F.lit(None).cast("int"))) is None
    assert not value(spark, audit.broken_internal(F.lit(600))) and value(spark, audit.broken_internal(F.lit(0)))
    assert not value(spark, audit.broken_external(F.lit(503), F.lit(None).cast("string")))
    assert value(spark, audit.broken_image(F.lit(503), F.lit(None).cast("string")))
    assert value(spark, audit.broken_link_check(F.lit(0))) and not value(spark, audit.broken_link_check(F.lit(403)))
    assert value(spark, audit.is_html_page(F.lit(200), F.lit(None).cast("string")))
