"""Related posts against all pairs."""

import datetime as dt
import random

import pytest

from sitegrain.operators import posts

SCHEMA = "slug string, published_at timestamp, tags array<string>"


def brute_force(rows, n):
    order = [s for s, _, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or dt.datetime(1970, 1, 1)).timestamp(), r[0]))]
    tags = {s: {t for t in ts or [] if t is not None} for s, _, ts in rows}
    out = []
    for slug in order:
        others = [s for s in order if s != slug]
        scored = sorted((-(len(tags[slug] & tags[s]) * 100 - i), s) for i, s in enumerate(others))[:n]
        out += [(slug, s, len(tags[slug] & tags[s]), -lost, rank) for rank, (lost, s) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("most,vocabulary", [(60, 70), (3, 5), (1, 400)])
def test_all_pairs(spark, most, vocabulary):
    random.seed(most)
    rows = []
    for i in range(500):
        tags = [f"t{min(vocabulary, int(random.expovariate(0.1)))}" for _ in range(random.randrange(most + 1))]
        rows.append((f"post{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=random.randrange(200)), random.choice([tags, tags, tags, tags + [None], None])))
    rows[7] = (rows[7][0], None, ["t1", "t2"])
    got = sorted(map(tuple, posts.related_posts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))
    assert got == brute_force(rows, 3)


def test_many_shared_tags_few_and_no_posts(spark):
    tags = [f"t{i}" for i in range(61)]
    two = [("a", dt.datetime(2024, 1, 1), tags), ("b", dt.datetime(2024, 1, 2), tags)]
    assert sorted(map(tuple, posts.related_posts(spark.createDataFrame(two, SCHEMA)).collect())) == [("a", "b", 61, 6100, 1), ("b", "a", 61, 6100, 1)]
    assert posts.related_posts(spark.createDataFrame(two[:1], SCHEMA)).collect() == [] and posts.related_posts(spark.createDataFrame([], SCHEMA)).collect() == []
