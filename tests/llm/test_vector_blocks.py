"""A query that visits many leaves is sent once to each block of rows, not once to each leaf."""

import numpy as np
from pyspark.sql import functions as F

from sitegrain.llm import vector_tree


def test_queries_travel_once_to_each_block(spark, monkeypatch):
    n = 3000
    monkeypatch.setattr(vector_tree, "LEAF_ROWS", 8)
    monkeypatch.setattr(vector_tree, "ROWS", 1000)
    settled = []
    write = vector_tree.cut_lineage
    monkeypatch.setattr(vector_tree, "cut_lineage", lambda df: settled.append(write(df)) or settled[-1])
    x = np.random.default_rng(3).normal(size=(n, 16))
    x[900:2100] = x[900]  # one leaf larger than a block
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vector_tree.nearest(rows, F.col("id") % 50 == 0).collect()
    sent = settled[-1]
    assert sent.count() <= 60 * 50 and sent.groupBy("id").count().count() == 60
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for i in range(0, n, 50):
        s = np.round(u @ u[i], 12)
        s[i] = -np.inf
        hits += len({*got[i]} & {*np.lexsort((np.arange(n), -s))[:5].tolist()})
    assert len(got) == 60 and hits >= 0.9 * 5 * 60
    assert got[1000] == [900, 901, 902, 903, 904]
