"""Click depth reads its links no more than twice, and gets the depths of a plain search whatever redirects and hubs there are."""

import random
from collections import defaultdict

import pytest

from sitegrain.operators import graph, ranking


def searched(starts, links, hops):
    """Depths by a 0-1 search, one click a link and none a redirect."""
    after, moved, depths = defaultdict(set), defaultdict(set), {}
    for site, src, dst in links:
        after[site, src].add((site, dst))
    for site, src, dst in hops:
        moved[site, src].add((site, dst))
    level, front = 0, set(starts)
    while front:
        todo, new = list(front), set()
        while todo:
            page = todo.pop()
            if page not in depths:
                depths[page] = level
                new.add(page)
                todo += moved[page]
        level, front = level + 1, {p for page in new for p in after[page]} - set(depths)
    return depths


@pytest.mark.parametrize("rows_per_part", [1_000_000, 7])
def test_links_are_read_twice_at_most(spark, rows_per_part):
    rnd = random.Random(5)
    links = [(f"s{k}", f"u{rnd.randrange(30)}", f"u{rnd.randrange(30)}") for k in range(4) for _ in range(45)] + [("s0", "u0", f"u{i % 40}") for i in range(60)]
    hops = [(f"s{k}", f"u{i}", f"u{(i * 3 + 1) % 30}") for k in range(3) for i in rnd.sample(range(30), 8)] + [("s3", "u1", "u2"), ("s3", "u2", "u1"), ("s0", "u5", "u5")]
    hops = list({(site, src): (site, src, dst) for site, src, dst in hops}.values())
    starts = [(f"s{k}", "u0") for k in range(4)]
    read = spark.sparkContext.accumulator(0)

    def counting(rows):
        for row in rows:
            read.add(1)
            yield row

    frame = spark.createDataFrame(spark.sparkContext.parallelize(links, 3).mapPartitions(counting), "site string, src string, dst string")
    pages = spark.createDataFrame(hops, "site string, url string, redirect_to string")
    depths = graph.click_depths(spark.createDataFrame(starts, "site string, url string"), graph.graph_edges(frame, pages), rows_per_part).collect()
    got = {(r["site"], r["url"]): r["depth"] for r in depths}
    assert len(depths) == len(got) and got == searched(starts, links, hops)
    # keys of full hashes are counted, and hubs are joined to their links, only if there are hubs
    assert read.value <= len(links) * (2 if rows_per_part > len(links) else 5)


def test_hot_keys_are_exact(spark):
    rows = [(f"k{i}",) for i in range(200) for _ in range(i % 5 + 1)]
    frame = spark.createDataFrame(rows, "k string")
    assert ranking.hot_keys(frame, ["k"], 1000) is None and ranking.hot_keys(frame, ["k"], 5) is None
    assert {(r["k"], r["_parts"]) for r in ranking.hot_keys(frame, ["k"], 3).collect()} == {(f"k{i}", 2) for i in range(200) if i % 5 > 2}
