"""Losses against the formula, scoring by one slice and by many, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sitegrain.llm import cross_entropy

SCHEMA = "doc_id long, text string, gram string, score string"


def expected(rows, chosen):
    plain = lambda t: ["\U0010fffe"] * 3 + list(t or "")
    count = {m: Counter() for m in "tb"}
    for i, t in rows:
        c = plain(t)
        for at in range(3, len(c)):
            for k in range(4):
                for m in "tb" if i in chosen else "b":
                    count[m]["".join(c[at - k : at + 1])] += 1
                    if k:
                        count[m]["h" + "".join(c[at - k : at])] += 1
    vocabulary = {g for g in count["b"] if len(g) == 1}
    total = {m: sum(n for g, n in count[m].items() if len(g) == 1 and g in vocabulary) for m in "tb"}

    def p(m, c, h):
        if h is None:
            return 1 / len(vocabulary)
        n = count[m]["h" + h] if h else total[m]
        return (count[m][h + c] + 10 * p(m, c, h[1:] if h else None)) / (n + 10)

    out = []
    for i, t in rows:
        c = plain(t)
        each = [[-math.log(p(m, c[at], "".join(c[at - 3 : at]))) for at in range(3, len(c))] for m in "tb"]
        out.append((i or 0, len(c) - 3, *(round(sum(x) / len(x), 9) if x else None for x in each)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [cross_entropy.SENT, 100])
def test_losses(spark, monkeypatch, sent):
    monkeypatch.setattr(cross_entropy, "SENT", sent)
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcd eéß\n") for _ in range(r.choice([1, 3, 40, 400])))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "😀a😁"), (43, "\0x"), (44, "\x01x\0"), (5, rows[5][1]), (None, "abc")]
    docs = spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA).repartition(3)
    found = cross_entropy.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in range(0, 30, 3)] + [(3,)], "doc_id long")).collect()
    got = sorted(((x.doc_id or 0, x.n_tokens, *(None if v is None else round(v, 9) for v in (x.target_loss, x.background_loss))) for x in found), key=repr)
    assert got == expected(rows, set(range(0, 30, 3)))
    assert all(x.score is None or abs(x.score - x.target_loss + x.background_loss) < 1e-12 for x in found)


def test_long_text(spark):
    rows = [(1, "ab😀" * 100_000 + "\0"), (2, "abc")]
    found = cross_entropy.cross_entropy_difference(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA), spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert sorted((x.doc_id, x.n_tokens) for x in found) == [(1, 300_001), (2, 3)]


def test_bitmap_leaves_out_no_chosen_text(spark, monkeypatch):
    """Also with so few bits that all of them are set."""
    rows = spark.range(2000).selectExpr("id", "CAST(id AS STRING) AS text")
    chosen = spark.range(0, 2000, 7).union(spark.range(3))
    for bits in (cross_entropy.MARKS, 1 << 16):
        monkeypatch.setattr(cross_entropy, "MARKS", bits)
        got = sorted(int(r.text) for r in cross_entropy.chosen_texts(rows, chosen).collect())
        assert got == sorted({*range(0, 2000, 7), 0, 1, 2})


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert cross_entropy.cross_entropy_difference(spark.createDataFrame([], SCHEMA), none).count() == 0
    r = cross_entropy.cross_entropy_difference(spark.createDataFrame([(1, "aab", "", "")], SCHEMA), none).first()
    assert abs(r.target_loss - math.log(2)) < 1e-9


def test_table_finds_and_misses():
    keys = np.unique(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000))
    table = cross_entropy.Table(keys[::2], np.stack([keys[::2] % 97, keys[::2] % 5], 1).astype(float))
    found = table.find(keys)
    assert (found[::2, 0] == keys[::2] % 97).all() and not found[1::2].any()
