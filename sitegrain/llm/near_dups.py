"""Near-duplicate groups by SetSketch registers.

A document is its set of distinct word shingles. Register i of its sketch is the exponentially spaced, truncated minimum of a
hash over the set, ``clip(floor(1 - log_b(min h_i)), 0, q + 1)``; the sketch of a union is the elementwise maximum. Documents
whose sketches agree on a whole band of registers are candidates. Of a candidate pair the likelihood of the counts of greater,
smaller and equal registers, given the two known set sizes, gives the similarity; pairs that may be similar are then confirmed
on their full sets. Links make components.

How it stays linear and whole under skew: equal sets become one class before anything else. A bucket is not expanded into its
pairs: its first member is compared with the others. The buckets whose members are then in more than one group of likely pairs are compared
in blocks of sketches, so that no pair of a bucket goes unseen; of a block only as many pairs come out as join its groups. Every link
lies within such a group, so a group's members meet once more in blocks, now with their full sets, most similar pairs first; a pair
whose documents are joined already needs no look. Rows lost with an executor are computed again: every table between steps is
written to the shared folder.

Defined results: a null or wordless text has no shingles and is linked with nothing. A row whose id is null has no component
(null) and is kept. A repeated row counts as one document. Where rows share an id but not a set, and the id is the smallest of both
sets, the set with the smaller fingerprint stands for it in links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import bytes_of, mix, own_columns, slices
from sitegrain.llm.components import components
from sitegrain.session import cut_lineage

#: Fixed sketch parameters: base and truncation of the register scale, rate of the exponentials.
BASE, LIMIT, RATE = 1.001, 2**16 - 2, 20.0
#: Bands and registers in a band. A pair at similarity 0.8 shares no band with a probability of (1 - 0.8 ** 6) ** 50 < 3e-7.
BANDS, ROWS = 50, 6
#: Bytes of text that are hashed at a time; the arrays for them take some fifty times as much.
TEXT_BYTES = 500_000
#: Rows of a block, and bytes of their sets, that are compared with as many others at a time.
BLOCK, BLOCK_BYTES = 1024, 8_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_P, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2 ** 64, for prefix hashes of n bytes."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, x)])) for x in (_P, inverse)]
    return _powers[0], _powers[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row of UTF-8 bytes, end to end, and how many each row has."""
    rows = len(offsets) - 1
    begin, end = offsets[:-1], offsets[1:]
    low = _LOWER[data]
    word = ~_SPACE[data]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = end > begin
    first[begin[full]] = word[begin[full]]
    last[end[full] - 1] = word[end[full] - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _C)
    word_end = np.searchsorted(first, end)
    words = word_end - np.searchsorted(first, begin)
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    doc = np.repeat(np.arange(rows), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(word_end - words, count)
    sets = hashes[at]
    for t in range(1, width):
        inside = at + t < word_end[doc]
        sets = np.where(inside, mix(sets * _C + hashes[np.minimum(at + t, len(hashes) - 1)] + np.uint64(t)), sets)
    stops = np.cumsum(count)
    for a, b in zip((stops - count).tolist(), stops.tolist(), strict=True):
        sets[a:b].sort()
    fresh = np.ones(len(sets), bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (doc[1:] != doc[:-1])
    return sets[fresh], np.bincount(doc[fresh], minlength=rows)


def registers(sets: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """SetSketch registers, one row for each non-empty set."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _P)
    out = np.empty((len(starts), n), np.uint32)
    for i in range(n):
        a, b = np.uint32(int(factors[i]) & 0xFFFFFFFF | 1), np.uint32(int(factors[i]) >> 32)
        out[:, i] = np.minimum.reduceat((x ^ b) * a, starts)
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketches of unions."""
    return np.maximum(a, b)


def likely_similarity(greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of two sets of known sizes, from how many registers of a are greater, smaller, equal to those of b."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    scale = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * scale) / np.log(BASE)

    def slope(j: np.ndarray) -> np.ndarray:
        """Of the log likelihood, which is concave in j."""
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        dx, dy = v * scale / (1 - x * scale) / np.log(BASE), u * scale / (1 - y * scale) / np.log(BASE)
        px, py = p(x), p(y)
        return -greater * dx / px - smaller * dy / py + equal * (dx + dy) / np.maximum(1 - px - py, 1e-12)

    low, high = np.zeros_like(u), most
    for _ in range(30):
        middle = (low + high) / 2
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def _sketch(width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets, TEXT_BYTES):
                sets, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                full = sizes > 0
                prints = np.zeros((2, b - a), np.int64)
                sketch: list[bytes | None] = [None] * (b - a)
                if full.any():
                    starts = (np.cumsum(sizes) - sizes)[full]
                    prints[0, full] = np.add.reduceat(mix(sets), starts).view(np.int64)
                    prints[1, full] = np.add.reduceat(mix(sets ^ _C), starts).view(np.int64)
                    for i, row in zip(np.flatnonzero(full).tolist(), registers(sets, sizes, n), strict=True):
                        sketch[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), pa.array(sketch, pa.binary())], ["id", "n", "f1", "f2", "sketch"])

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            key = np.zeros((batch.num_rows, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for t in range(rows):
                key = mix(key * _C + sketch[:, t : bands * rows : rows].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), bands))], ["bucket", "id"])

    return run


def _least_estimate(share: int, n: int) -> float:
    """Six standard deviations of the estimate below the threshold: no link is lost to the estimate."""
    j = share / 100
    return j - 6 * (j * (1 - j) / n) ** 0.5


def _estimates(share: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _least_estimate(share, n)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_sketches(batch.column(c)) for c in ("sketch_a", "sketch_b"))
            j = likely_similarity((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")))
            yield batch.filter(pa.array(j >= least)).select(["a", "b"])

    return run


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets, TEXT_BYTES):
                sets, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                stops = np.cumsum(sizes)
                packed = [sets[x:y].tobytes() for x, y in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(packed, pa.binary())], ["id", "items"])

    return run


class _Joined:
    """Which members of a block are joined."""

    def __init__(self, names: np.ndarray):
        self.of = {x: x for x in names.tolist()}

    def root(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = x = self.of[self.of[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.of[self.root(a)] = self.root(b)


def _likely_pairs(rows: pa.Table, apart: np.ndarray, share: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, similarities) of each row with the later rows that may be similar to it and, in a pair of blocks, are in the other one."""
    least, sketch, size, block = _least_estimate(share, n), _sketches(rows.column("sketch")), rows.column("n").to_numpy(), rows.column("block").to_numpy()
    across = len(np.unique(rows.column("x").to_numpy())) and rows.column("x")[0].as_py() != rows.column("y")[0].as_py()
    for i in range(len(size) - 1):
        close = (100 * np.minimum(size[i], size[i + 1 :]) >= share * np.maximum(size[i], size[i + 1 :])) & (apart[i] != apart[i + 1 :])
        other = i + 1 + np.flatnonzero(close & (block[i] != block[i + 1 :]) if across else close)
        if len(other):
            a, c = sketch[i], sketch[other]
            j = likely_similarity((a > c).sum(1), (a < c).sum(1), (a == c).sum(1), np.full(len(other), float(size[i])), size[other].astype(float))
            if (j >= least).any():
                yield i, other[j >= least], j[j >= least]


def _pairs_table(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _join_groups(share: int, n: int):
    """Of a block of a bucket, as many likely pairs as join its members' groups."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        name, group = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        joined, out = _Joined(np.unique(group)), []
        for i, other, _ in _likely_pairs(rows, group, share, n):
            for j in other.tolist():
                if joined.root(int(group[i])) != joined.root(int(group[j])):
                    joined.join(int(group[i]), int(group[j]))
                    out.append((int(name[i]), int(name[j])))
        return _pairs_table(out)

    return run


def _confirmed(share: int, n: int):
    """Of a block of a group, as many links, confirmed on full sets, as join all that a link joins."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        name, items = rows.column("id").to_numpy(), rows.column("items")
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in (items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items)]
        joined, out = _Joined(np.arange(len(name))), []
        found = [(np.full(len(other), i), other, j) for i, other, j in _likely_pairs(rows, np.arange(len(name)), share, n)]
        if found:
            left, right, j = (np.concatenate(x) for x in zip(*found, strict=True))
            for at in np.argsort(-j, kind="stable").tolist():
                x, y = int(left[at]), int(right[at])
                if joined.root(x) != joined.root(y):
                    both = np.sort(np.concatenate([sets[x], sets[y]]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= share * (len(both) - common):
                        joined.join(x, y)
                        out.append((int(name[x]), int(name[y])))
        return _pairs_table(out)

    return run


def _block_pairs(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Each row once for each pair of blocks (x <= y) of its key that its own block is in; ``blocks`` says how many a key has."""
    dealt = rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks")
    return dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row: groups of documents linked by ``100 * common >= share * union`` of their shingle sets of ``width`` words.

    ``share`` is a percentage. One row out for each row in; of a component the row with the smallest id is kept.
    """
    n = bands * rows
    docs = own_columns(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    rows_of = cut_lineage(docs.mapInArrow(_sketch(width, n), "id long, n long, f1 long, f2 long, sketch binary"))
    full = rows_of.where("n > 0 AND id IS NOT NULL")
    # one class for each set; a hot class is added up before the shuffle
    classes = cut_lineage(full.groupBy("f1", "f2", "n").agg(F.min("id").alias("id")))
    chosen = classes.groupBy("id").agg(F.min(F.struct("f1", "f2", "n")).alias("s"))
    # merge joins throughout: the plan is the same at every size
    reps = full.join(chosen.hint("merge"), "id").where("f1 = s.f1 AND f2 = s.f2 AND n = s.n").dropDuplicates(["id"])
    reps = cut_lineage(reps.select("id", "n", "sketch"))

    banded = reps.select("id", "sketch").mapInArrow(_bands(bands, rows), "bucket long, id long")
    shared = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(banded.join(shared.hint("merge"), "bucket"))
    a, b = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    stars = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(share) * F.greatest("n_a", "n_b"))
    likely = cut_lineage(stars.mapInArrow(_estimates(share, n), "a long, b long"))

    groups = components(likely, "a", "b")
    of = members.join(groups.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    blocks = of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low <> high").select("bucket", "blocks")
    mixed = _block_pairs(of.join(reps, "id"), "bucket", blocks)
    more = cut_lineage(mixed.groupBy("bucket", "x", "y").applyInArrow(_join_groups(share, n), "a long, b long"))

    groups = components(likely.union(more), "a", "b")
    sets = docs.join(groups.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi").mapInArrow(_sets(width), "id long, items binary")
    grouped = cut_lineage(groups.withColumnRenamed("node", "id").join(reps.hint("merge"), "id").join(sets.hint("merge"), "id").where(F.length("items") == 8 * F.col("n")).dropDuplicates(["id"]))
    blocks = grouped.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("items")) / BLOCK_BYTES)).alias("blocks"))
    links = _block_pairs(grouped, "component", blocks).groupBy("component", "x", "y").applyInArrow(_confirmed(share, n), "a long, b long")
    found = components(links, "a", "b")

    of_class = rows_of.select("id", "n", "f1", "f2").join(classes.withColumnRenamed("id", "rep"), ["f1", "f2", "n"], "left")
    node = F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id"))
    out = of_class.select("id", "n", node.alias("node")).join(found.select(F.col("node"), "component"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
