"""Nearest neighbours by cosine through a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` rows, smallest hashes first) and every row is put into the leaf that it descends
to. A query walks the tree best bin first: a priority queue holds the children not yet taken, nearest centroid on top, so that
leaves come out in the order of promise. How many leaves are visited is calibrated: queries of the sample are sorted by how near their
best leaf is, and for each quarter of them the visits widen until the recall of their true neighbours within the sample reaches
``recall``. Queries between rows of tight clusters visit a few leaves and those in empty space many.

Neighbouring leaves share a block of rows, and a leaf too large for one is dealt over several. A query goes once to each block that holds leaves it
visits, with their names, not once to every leaf; there it meets the rows of these leaves only, as matrix products. Scores that are returned are
computed again from the original vectors, in double precision.

Defined results: vectors that are null, zero, of another length than the commonest, or hold null or non-finite components take no part.
With fewer rows than k, all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.llm.common import own_columns
from sitegrain.llm.vectors import matrix, usable
from sitegrain.session import cut_lineage

#: Rows that the tree is fitted on and queries that the visits are calibrated with, at most.
SAMPLE, TRIALS = 20_000, 400
#: Children of a node, and rows that a leaf should hold as long as the tree is not at its greatest depth.
BRANCH, LEAF_ROWS, DEPTH = 8, 1024, 4
#: Rows and queries of a block, at most, and blocks of rows that even a small table has.
ROWS, QUERIES, SPREAD = 8192, 8192, 32
#: Queries on their way to blocks, and scores of a block, that a worker holds at a time.
SENT, SCORES = 4096, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means, begun with far points."""
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    nearest = x @ chosen[0]
    for _ in range(k - 1):
        far = np.maximum(1 - nearest, 0) ** 2
        if not far.sum():
            break
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        nearest = np.maximum(nearest, x @ chosen[-1])
    c = np.stack(chosen)
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(c)) > 0
        c = np.where(full[:, None], _unit(sums), c)
    return c


class Tree:
    """Inner nodes as lists of child centroids and child numbers; a negative child is the leaf of that complement."""

    def __init__(self, x: np.ndarray, depth: int):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        self.visits: list[tuple[float, int]] = []
        self.root = self._grow(x, depth)

    def _grow(self, x: np.ndarray, depth: int) -> int:
        c = _centroids(x, BRANCH, len(self.nodes)) if depth and len(x) > BRANCH else None
        if c is None or len(c) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.nodes)
        self.nodes.append((c, []))
        own = (x @ c.T).argmax(1)
        self.nodes[node][1].extend([self._grow(x[own == i], depth - 1) for i in range(len(c))])
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row descends to."""
        at = np.full(len(x), self.root)
        while (inner := np.unique(at[at >= 0])).size:
            for node in inner.tolist():
                rows = np.flatnonzero(at == node)
                c, children = self.nodes[node]
                at[rows] = np.asarray(children)[(x[rows] @ c.T).argmax(1)]
        return ~at

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaves best bin first, with the similarity of each one's centroid."""
        queue = [(-1.0, 0, self.root)]
        pushed = 0
        while queue:
            near, _, node = heapq.heappop(queue)
            if node < 0:
                yield ~node, -near
                continue
            c, children = self.nodes[node]
            for s, child in zip((c @ q).tolist(), children, strict=True):
                pushed += 1
                heapq.heappush(queue, (-s, pushed, child))

    def calibrate(self, x: np.ndarray, trials: np.ndarray, k: int, recall: float) -> None:
        """Set how many leaves a query visits, by the similarity of its best leaf."""
        leaf = self.leaf_of(x)
        best, needed = [], []
        for t in trials.tolist():
            s = x @ x[t]
            s[t] = -np.inf
            true = np.argsort(-s, kind="stable")[:k]
            order = [*self.walk(x[t])]
            rank = {name: i for i, (name, _) in enumerate(order)}
            best.append(order[0][1])
            needed.append([rank[n] + 1 for n in leaf[true].tolist()])
        by = np.argsort(best)
        self.visits = []
        for part in np.array_split(by, 4):
            if len(part):
                every = np.sort(np.concatenate([needed[i] for i in part])) if k else np.ones(1)
                at = min(len(every) - 1, int(np.ceil(recall * len(every))))
                self.visits.append((best[part[-1]], int(every[at])))

    def leaves_for(self, q: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
        """Leaves that a query visits: as many as calibrated, and more until k rows besides its own are there."""
        out: list[int] = []
        rows, most = 0, self.leaves
        for leaf, near in self.walk(q):
            if not out and self.visits:
                most = next((n for top, n in self.visits if near <= top), self.visits[-1][1])
            out.append(leaf)
            rows += int(counts[leaf])
            if len(out) >= most and rows > k:
                break
        return out


def fit(rows: DataFrame, k: int, recall: float) -> Tree:
    """A tree over usable rows and its calibrated visits."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    x = _unit(matrix(sample.column("v"))) if sample.num_rows else np.zeros((1, 1))
    depth = int(np.clip(np.ceil(np.log(max(n, 1) / LEAF_ROWS) / np.log(BRANCH)), 0, DEPTH))
    tree = Tree(x, depth)
    if sample.num_rows > k:
        tree.calibrate(x, np.arange(min(TRIALS, len(x))), k, recall)
    return tree


def _to_leaf(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(tree.leaf_of(_unit(matrix(batch.column("v")))), pa.int32())], ["id", "v", "leaf"])

    return run


def _deal(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each leaf, -1 where it is empty, and its number of blocks. Leaves beside each other share a block as long as it holds
    ``ROWS`` rows at most, fewer in a small table, so that it has about ``SPREAD`` blocks; a larger leaf has several of its own."""
    size = int(np.clip(counts.sum() // SPREAD, min(LEAF_ROWS, ROWS), ROWS))
    first, parts = np.full(len(counts), -1), np.ones(len(counts), np.int64)
    blocks, room = 0, 0
    for leaf in np.flatnonzero(counts).tolist():
        n = int(counts[leaf])
        if n > room:
            first[leaf], parts[leaf] = blocks, -(-n // size)
            blocks += int(parts[leaf])
            room = max(0, size - n)
        else:
            first[leaf] = blocks - 1
            room -= n
    return first, parts


def _to_blocks(tree: Tree, counts: np.ndarray, first: np.ndarray, parts: np.ndarray, k: int):
    """A query goes once to each block that holds leaves it visits, with their names. At most about ``SENT`` rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            to: list[int] = []
            named: list[np.ndarray] = []
            for i, q in enumerate(_unit(matrix(batch.column("v"))) if batch.num_rows else []):
                leaves = np.sort(np.asarray(tree.leaves_for(q, counts, k)))
                leaves = leaves[first[leaves] >= 0]
                blocks, begin = np.unique(first[leaves], return_index=True)
                for block, own in zip(blocks.tolist(), np.split(leaves, begin[1:]), strict=bool(len(blocks))):
                    n = int(parts[own[0]])
                    at += [i] * n
                    to += range(block, block + n)
                    named += [own] * n
                if at and (len(at) >= SENT or i + 1 == batch.num_rows):
                    ends = pa.array(np.cumsum([0, *map(len, named)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(named), pa.int32()))
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("v").take(rows), pa.array(to, pa.int32()), lists], ["id", "v", "block", "leaves"])
                    at, to, named = [], [], []

    return run


def _best_of_block(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by("leaf")
            q_id, r_id = (t.column("id").to_numpy() for t in (queries, rows))
            q, r = matrix(queries.column("v")), matrix(rows.column("v"))
            q_norm, r_norm = (np.sqrt((x * x).sum(1)) for x in (q, r))
            q_unit, r_unit = _unit(q), _unit(r)
            leaves, begin = np.unique(rows.column("leaf").to_numpy(), return_index=True)
            end = np.append(begin[1:], len(r))
            lists = queries.column("leaves").combine_chunks()
            asking, asked = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            step = max(1, SCORES // len(r))
            for low in range(0, len(q), step):
                high = min(low + step, len(q))
                own = slice(*np.searchsorted(asking, [low, high]))
                s = np.full((high - low, len(r)), -np.inf)
                order = np.argsort(asked[own], kind="stable")
                names, by = asked[own][order], asking[own][order]
                for leaf, a, b in zip(leaves.tolist(), begin.tolist(), end.tolist(), strict=True):
                    who = by[slice(*np.searchsorted(names, [leaf, leaf + 1]))]
                    if len(who):
                        s[who - low, a:b] = q_unit[who] @ r_unit[a:b].T
                s[q_id[low:high, None] == r_id] = -np.inf
                last = max(0, len(r) - k)
                least = np.partition(s, last, axis=1)[:, last] - 1e-9
                for i in range(low, high):
                    near = np.flatnonzero((s[i - low] >= least[i - low]) & (s[i - low] > -np.inf))
                    exact = (r[near] * q[i]).sum(1) / (r_norm[near] * q_norm[i])
                    best = np.lexsort((r_id[near], -exact))[:k]
                    found.append((np.full(len(best), q_id[i]), r_id[near[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row where ``is_query`` (of the column ``id``) holds, the k nearest others that the tree finds.

    Nearest first, of equals the smaller id.
    """
    chosen = own_columns(vectors, id=id_col).select(F.col("id").cast("long").alias("id")).where(is_query).distinct()
    rows = cut_lineage(usable(vectors, id_col, vector_col, zero=False))
    tree = fit(rows, k, recall)
    placed = cut_lineage(rows.mapInArrow(_to_leaf(tree), "id long, v array<double>, leaf int"))
    sizes = placed.groupBy("leaf").count().toArrow()  # a row for each leaf, of which there are BRANCH ** DEPTH at most
    counts = np.zeros(tree.leaves, np.int64)
    counts[sizes.column("leaf").to_numpy()] = sizes.column("count").to_numpy()
    first, parts = _deal(counts)
    spark = vectors.sparkSession
    queries = rows.join(chosen, "id", "left_semi").repartition(spark.sparkContext.defaultParallelism, "id")
    asked = cut_lineage(queries.mapInArrow(_to_blocks(tree, counts, first, parts, k), "id long, v array<double>, block int, leaves array<int>"))
    dealt = spark.createDataFrame(list(zip(range(tree.leaves), first.tolist(), parts.tolist(), strict=True)), "leaf int, first int, parts int")
    groups = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asked.join(groups, "block").select("id", "v", "leaves", "block", part("groups").alias("y"))
    held = placed.join(dealt, "leaf").withColumn("block", F.col("first") + part("parts"))
    right = held.join(groups, "block").select("id", "v", "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("y"))
    best = left.groupBy("block", "y").cogroup(right.groupBy("block", "y")).applyInArrow(_best_of_block(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
