"""Sitemap entries keep the flag of their site, and the sitemap queries parse each landed file once."""

from conftest import SMALL

from sitegrain.operators import graph
from sitegrain.plans import audits
from sitegrain.sources import responses


def test_files_are_parsed_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    parse, made = responses.parse_sitemaps, []

    def counting(files):
        def each(rows):
            for row in rows:
                read.add(1)
                yield row

        made.append(files.count())
        return parse(spark.createDataFrame(files.rdd.mapPartitions(each), files.schema))

    monkeypatch.setattr(responses, "parse_sitemaps", counting)
    got = audits.sitemap_summary(spark, SMALL).collect()
    assert len(got) > 0 and read.value == made[0] > 0


def test_partial_is_of_the_site(spark):
    index = [("s", "root", "index", f"m{i}", i, None) for i in range(4)] + [("t", "root", "index", "m0", 0, None)]
    leaves = [("s", f"m{i}", "urlset", f"u{i % 3}", i, f"2024-01-0{i + 1}") for i in range(4)] + [("t", "m0", "urlset", "u", 0, None)]
    entries = spark.createDataFrame(index + leaves, "site string, sitemap string, kind string, loc string, ord long, lastmod string")
    roots = spark.createDataFrame([("s", "root", 0), ("t", "root", 0)], "site string, sitemap string, ord long")

    def urls(sitemaps, limit):
        rows = graph.collect_sitemap_urls(graph.expand_sitemaps(roots, entries, sitemaps), entries, limit).collect()
        return sorted((r["site"], r["position"], r["loc"], r["lastmod"], r["partial"]) for r in rows)

    every = [("s", 1, "u0", "2024-01-01"), ("s", 2, "u1", "2024-01-02"), ("s", 3, "u2", "2024-01-03"), ("t", 1, "u", None)]
    assert urls(None, None) == [(*r, False) for r in every]
    assert urls(3, None) == [(*r, r[0] == "s") for r in every if r[1] < 3]
    assert urls(None, 2) == [(*r, r[0] == "s") for r in every if r[1] < 3]
