"""Spelling variants against all pairs of a small vocabulary, and the k-d tree against a plain scan."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sitegrain.llm import spelling

SCHEMA = "doc_id long, text string, n string, word string"


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows, erased=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % erased == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    found = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        found.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(found)


def result(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def corpus():
    random.seed(7)
    base = ["".join(random.choices("abcdeéñ", k=random.randrange(7, 12))) for _ in range(60)] + ["y" * 70, "z" * 63, "Àx" * 40]
    rows = [(None, "Nothing nothing NOTHING"), (1, None), (2, ""), (3, "short wörd x"), (4, "×÷" * 5), (4, "×÷" * 5)]
    for i in range(300):
        words = []
        for _ in range(random.randrange(1, 25)):
            w = random.choice(base[: random.randrange(1, len(base) + 1)])
            if random.random() < 0.35:
                at = random.randrange(len(w))
                w = random.choice([w[:at] + w[at + 1 :], w[:at] + random.choice("abñ") + w[at:], w[:at] + random.choice("abÿ") + w[at + 1 :]])
            words.append(w.upper() if random.random() < 0.2 else w)
        rows.append((random.choice([i, i // 2]), random.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("block,visitors,fewest", [(400_000, 3_000_000, 64), (60, 300, 2)])
def test_all_pairs(spark, monkeypatch, block, visitors, fewest):
    """Small blocks put the words in many leaves and blocks of leaves and of visitors."""
    for name, value in (("BLOCK", block), ("VISITORS", visitors), ("FEWEST", fewest)):
        monkeypatch.setattr(spelling, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "n", "w") for d, t in rows], SCHEMA).repartition(4)
    want = brute_force(rows)
    assert len(want) > 100 and any(f for _, f, *_ in want)
    assert result(spelling.spelling_groups(docs)) == want


def test_sampled_trees(spark, monkeypatch):
    """Words outside of the sample that the trees were fitted on are found as well."""
    for name, value in (("BLOCK", 100), ("FEWEST", 2), ("SAMPLE", 20)):
        monkeypatch.setattr(spelling, name, value)
    rows = corpus()
    assert result(spelling.spelling_groups(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA))) == brute_force(rows)


def test_long_way_to_the_root(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w0"), ("y", "z")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {f"w{i}": "w21" for i in range(21)} | {"x": "w21", "y": "z"}


def test_empty_table(spark):
    assert result(spelling.spelling_groups(spark.createDataFrame([], SCHEMA))) == []


def test_very_long_text(spark):
    rows = [(1, "Wordplay " * 50_000 + "wordpley " * 3 + "a" * 100_000 + " " + "a" * 100_000 + " " + ("a" * 99_999 + "b ") * 2)]
    assert result(spelling.spelling_groups(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA), erased=None)) == [
        ("a" * 100_000, None, "a" * 100_000, 2, 1, None), ("a" * 99_999 + "b", None, "a" * 99_999 + "b", 2, 1, None),
        ("wordplay", None, "wordplay", 50_000, 1, None), ("wordpley", "wordplay", "wordplay", 3, 1, 50_000),
    ]


def test_tree_reaches_all_boxes():
    """Every point within one letter more and one less lies in a leaf that is reached, in a tree of its own points and in one of others."""
    rng = np.random.default_rng(3)
    points = rng.poisson(0.7, (400, 12)).astype(np.int32)
    asked = rng.poisson(0.7, (150, 12)).astype(np.int32)
    for tree in (spelling.Tree(points, lambda n: n > 4, True), spelling.Tree(points[:50], lambda n: n > 3, False)):
        leaf_of = tree.leaf_of(points)
        for more, less in ((1, 1), (1, 0)):
            q, leaf = tree.reached(asked, more, less)
            reached = set(zip(q.tolist(), leaf.tolist(), strict=True))
            assert len(reached) == len(q)
            for i, a in enumerate(asked):
                step = points - a
                good = (np.maximum(step, 0).sum(1) <= more) & (np.maximum(-step, 0).sum(1) <= less)
                assert all((i, leaf_of[j]) in reached for j in np.flatnonzero(good).tolist())
            assert len(reached) < 0.5 * len(asked) * (tree.dim < 0).sum()
