"""Near-duplicate groups against all pairs of small random documents, and the sketch's own properties."""

import random
import re

import numpy as np
import pytest

from sitegrain.llm import near_dups
from sitegrain.llm.components import components

SCHEMA = "doc_id long, text string, kept string, component_id string"


def expected(rows, width):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    return {i: (len(sets[i]), of[i], of[i] == i) for i in sets}


def texts(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Straße", "ÄB", "x y", "Z"]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 40, 200]))] for _ in range(25)]
    out = [None, "", " \t\n\v\f\r ", "one", "ONE", "one two", "two one", "x" * 50_000, " ".join(vocabulary * 30)]
    for words in base:
        for _ in range(r.randint(1, 6)):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, len(copy) // 30, len(copy) // 12])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\n", "  "]).join(copy).swapcase() if r.random() < 0.3 else " ".join(copy))
    r.shuffle(out)
    return list(enumerate(out, 5))


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_all_pairs(spark, width):
    rows = texts(width)
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, width=width).collect()}
    assert got == expected(rows, width)


def test_empty_repeated_and_null_ids(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    out = near_dups.near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_block_pass_links_what_the_stars_left(spark, monkeypatch):
    """A bucket of many members in small blocks: every pair across components is seen."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    words = [f"v{i}" for i in range(300)]
    chain = [(i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(20)]
    assert {i: c for i, (_, c, _) in expected(chain, 2).items()} == {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), width=2).collect()}


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(3)
    a, b = (np.unique(r.integers(0, 2**63, 4000).astype(np.uint64)) for _ in "ab")
    both = np.unique(np.concatenate([a, b[:1000]]))
    one = lambda x: near_dups.registers(x, np.array([len(x)]), 300)
    assert (near_dups.merge(one(a), one(b[:1000])) == one(both)).all()
    x, y = one(a), one(both)
    j = near_dups.likely_similarity((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), np.array([float(len(a))]), np.array([float(len(both))]))
    assert abs(j[0] - len(a) / len(both)) < 0.08


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    of = {x: x for pair in links for x in pair}
    for _ in of:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    lone = {x for x in of if all(a == b for a, b in links if x in (a, b))}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: c for x, c in of.items() if x not in lone}
