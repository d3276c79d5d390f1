"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sitegrain.llm import impact_index, vector_tree

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 0, 0) for i, v in rows], SCHEMA)


def mixed(n, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, 16))
    x = np.where((np.arange(n) % 3 == 0)[:, None], r.normal(size=(n, 16)), centres[r.integers(0, 8, n)] + r.normal(size=(n, 16)) * 0.05) / 4
    x[n // 3 : n // 3 + 40] = x[n // 3]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32))]
    bad = [(n, None), (n + 1, []), (n + 2, [float("nan")] * 16), (n + 3, [float("inf")] * 16), (n + 4, [None] * 16), (n + 5, [1.0] * 3), (5000, [0.0] * 16), (None, [1.0] * 16)]
    return x.astype(np.float32).astype(float), rows + bad


def best(s, i, k):
    s = s.astype(float)
    return sorted((-s[j], j) for j in range(len(s)) if j != i)[:k]


def test_tree_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(vector_tree, "LEAF_ROWS", 64)
    monkeypatch.setattr(vector_tree, "ROWS", 100)
    monkeypatch.setattr(vector_tree, "QUERIES", 16)
    x, rows = mixed(1500, 1)
    got = {}
    for r in vector_tree.nearest(frame(spark, rows), F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 1500, 10))
    hits = 0
    for i, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all(r.vec_id != i for r in found)
        assert np.allclose([r.score for r in found], u[[r.vec_id for r in found]] @ u[i], atol=1e-12)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {j for _, j in best(np.round(u @ u[i], 12), i, 5)})
    assert hits >= 0.9 * 5 * len(got)


def test_impact_index_is_exact(spark, monkeypatch):
    for name, n in {"ROWS": 300, "QUERIES": 40, "PART": 70}.items():
        monkeypatch.setattr(impact_index, name, n)
    x, rows = mixed(900, 2)
    v = np.floor(64 * x).astype(int)
    got = {}
    for r in impact_index.top_k(frame(spark, [*rows, rows[3]]), F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    v5000 = np.vstack([v, np.zeros((1, 16), int)])
    names = [*range(900), 5000]
    for at, i in [*((i, i) for i in range(0, 900, 20)), (900, 5000)]:
        s = v5000 @ v5000[at]
        want = [(k + 1, int(-a), names[j]) for k, (a, j) in enumerate(best(s, at, 20))]
        assert sorted(got[i]) == want
    assert len(got) == 46


def test_few_and_no_rows(spark):
    few = frame(spark, [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, -1.0]), (8, [1.0])])
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in vector_tree.nearest(few, F.col("id") % 50 == 0).collect()) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in impact_index.top_k(few, F.col("id") % 50 == 0).collect()) == [(0, 1, 50, 4096), (0, 2, 7, 0), (50, 1, 0, 4096), (50, 2, 7, -4096)]
    for rows in ([], [(0, None)], [(0, [1.0, 2.0])]):
        assert vector_tree.nearest(frame(spark, rows), F.col("id") % 50 == 0).count() == 0
        assert impact_index.top_k(frame(spark, rows), F.col("id") % 20 == 0).count() == 0
