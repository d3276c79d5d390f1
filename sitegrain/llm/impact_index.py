"""Exact top-k by integer inner product through an impact-ordered index, score at a time.

Each component is turned into an integer, and a block of rows is indexed by it: for each dimension, the rows of each value make one
posting segment. Shifted by what a dimension gives at the least, a segment adds ``|q| * (value - lowest)`` to the score of its rows where
the query's component is positive and ``|q| * (highest - value)`` where it is negative, so all that it adds is an impact of 0 or
more. Segments are taken by descending impact for a block of queries at once, into one accumulator per row and query.

After a part of the segments, a query is finished if it is proven which rows can still be among its best: the rows whose score so far,
with the most that the segments to come can add, reaches the k-th best score so far. When these are few, they are scored exactly
and the query leaves the accumulator. A query for which no such proof appears runs through all segments, after which its
scores are the exact ones. No row is given up without proof.

Defined results: vectors that are null, of another length than the commonest, or hold null or non-finite components take no part; zero
vectors do. With fewer rows than k, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.llm.common import own_columns
from sitegrain.llm.vectors import blocked, matrix, usable
from sitegrain.session import cut_lineage

#: Rows and queries that meet in one task, and rows that are indexed together there.
ROWS, QUERIES, PART = 16_384, 1024, 4096
#: Shares of the segments after which proofs are looked for, and possible members per wanted one that are few enough to score exactly.
LOOKS, FEW = (0.5, 0.7, 0.85), 4


def segments(r: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(dimension, value, rows) of each posting segment."""
    out = []
    for d in range(r.shape[1]):
        order = np.argsort(r[:, d], kind="stable")
        values = r[order, d]
        cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        out.extend((d, int(values[c]), order[c:e]) for c, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True))
    return out


def best_rows(q: np.ndarray, r: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each query, rows that are sure to hold its k best (and all rows that tie with them), found score at a time."""
    low, high = r.min(0), r.max(0)
    parts = segments(r)
    impact = np.stack([np.where(q[:, d] >= 0, q[:, d] * (v - low[d]), -q[:, d] * (high[d] - v)) for d, v, _ in parts])
    order = np.argsort(-impact.max(1), kind="stable")
    dims = np.asarray([d for d, _, _ in parts])
    active, out = np.arange(len(q)), [np.zeros(0, np.int64)] * len(q)
    scores = np.zeros((len(r), len(q)), np.int64 if np.abs(impact).max(initial=0) * r.shape[1] > 2**31 - 1 else np.int32)
    impact = impact.astype(scores.dtype)
    looks = [int(x * len(order)) for x in LOOKS] + [len(order)]
    done = 0
    for look in looks:
        for s in order[done:look].tolist():
            scores[parts[s][2]] += impact[s]
        done = look
        to_come = np.zeros(len(active), np.int64)
        rest = order[done:]
        for d in np.unique(dims[rest]).tolist():
            to_come += impact[rest[dims[rest] == d]].max(0)
        kth = np.partition(scores, max(0, len(r) - k), axis=0)[max(0, len(r) - k)]
        possible = scores >= kth - to_come
        few = possible.sum(0) <= FEW * k if done < len(order) else np.ones(len(active), bool)
        for i in np.flatnonzero(few).tolist():
            out[active[i]] = np.flatnonzero(possible[:, i])
        if few.any():
            active, scores, impact = active[~few], np.ascontiguousarray(scores[:, ~few]), impact[:, ~few]
        if not len(active):
            break
    return out


def _search(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_id, r_id = (t.column("id").to_numpy() for t in (queries, rows))
        found: list[list[tuple[int, int]]] = [[] for _ in q_id]
        if len(q_id) and len(r_id):
            q, r = (matrix(t.column("v")).astype(np.int64) for t in (queries, rows))
            for start in range(0, len(r), PART):
                part, names = r[start : start + PART], r_id[start : start + PART]
                for i, at in enumerate(best_rows(q, part, k + 1)):  # one more, as the query itself may be there
                    exact = part[at] @ q[i]
                    found[i] += [(-s, n) for s, n in zip(exact.tolist(), names[at].tolist(), strict=True) if n != q_id[i]]
            found = [sorted(set(x))[:k] for x in found]
        flat = [(int(i), n, -s) for i, x in zip(q_id, found, strict=True) for s, n in x]
        columns = [*zip(*flat, strict=True)] if flat else [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row where ``is_query`` (of the column ``id``) holds, the k other rows with the highest inner product of ``floor(scale * component)``.

    Highest first, of equals the smaller id.
    """
    chosen = own_columns(vectors, id=id_col).select(F.col("id").cast("long").alias("id")).where(is_query).distinct()
    rows = usable(vectors, id_col, vector_col, zero=True)
    rows = cut_lineage(rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")))
    asked = rows.join(chosen, "id", "left_semi")
    nx, ny = blocked(rows.count(), ROWS), blocked(asked.count(), QUERIES)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", every(nx).alias("x"), block(ny).alias("y"))
    right = rows.select("id", "v", block(nx).alias("x"), every(ny).alias("y")).toDF("id", "v", "x", "y")
    best = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
