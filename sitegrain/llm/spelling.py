"""Groups of spelling variants: words that differ by one code point, found by k-d trees over letter counts.

A word is a vector of how often it holds each letter. One inserted, deleted or replaced code point moves that vector by an L1 distance of
at most two: a replacement takes one letter away and adds another, an insertion adds one. So the words near a word of length L lie in two
boxes: among words of length L within one letter less and one letter more, and among words of length L + 1 within one letter more.
Each length has a tree of its own (words of ``LONG`` code points and more share one), and a range search visits only the boxes that such a step
can reach. What is left is compared by the parities of its counts, and then the order of letters is verified.

The upper part of each tree is fitted on at most ``SAMPLE`` words (in expectation), chosen by hash; every word is placed and searched. A leaf
with more than ``BLOCK`` code points is dealt into blocks, and its visitors as well, so a task holds one block of each however the
words lie. Inside a task a tree is built over the block, down to ``BUCKET`` words, and the visitors descend it together.

Defined results: a null text has no words and a null id reads as empty text in the checksum; repeated rows count again; of near words
with equal counts the first in code-point order is the form. Texts are read whole and in the JVM, a word of any length is handled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitegrain.llm.common import own_columns
from sitegrain.session import cut_lineage, forget

#: Words from this length on share a tree.
LONG = 64
#: Words that the upper trees are fitted on, and the fewest of them that are divided.
SAMPLE, FEWEST = 100_000, 64
#: Code points of a leaf's block, and of a block of its visitors.
BLOCK, VISITORS = 400_000, 3_000_000
#: Words in a bucket of a tree inside a task, and visitors that descend it at a time.
BUCKET, TOGETHER = 8, 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The place of each letter (as a Latin-1 byte) in a vector.
PLACE = np.full(256, -1, np.int16)
PLACE[97:123] = np.arange(26)
PLACE[0xC0:] = 26 + np.arange(64)
LETTERS = 90
#: Each letter's bit in a word of parities; letters beyond the 64th share bits, which only weakens the first comparison.
BIT = np.uint64(1) << (np.arange(LETTERS) % 64).astype(np.uint64)


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, erased: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of Latin letters with A-Z lowered, of at least so many code points and occurrences.

    Where ``erased`` divides the crc32 of ``<id>:<run>``, the run's code point at crc32 modulo its length is deleted first; None leaves runs as they are.
    """
    rows = own_columns(docs, id=id_col, text=text_col)
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("([A-Za-zÀ-ÿ]+)"), 1)
    words = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if erased is None:
        words = words.select(F.col("run").alias("word"))
    else:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = F.pmod("h", F.length("run")).cast("int")
        deleted = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        words = words.select(F.when(F.col("h") % erased == 0, deleted).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """How often each word, in Latin-1, holds each letter."""
    letters = PLACE[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(owner * LETTERS + letters, minlength=len(words) * LETTERS)
    return counts.reshape(len(words), LETTERS).astype(np.int32)


class Tree:
    """Nodes of a k-d tree as arrays; ``dim`` is -1 at a leaf, which holds ``first`` to ``last`` of ``order``.

    ``ranges`` has for each node, on its own dimension, the least and most that its ancestors left, and those of both children. A child's
    range is what its points span if ``tight``, or only what the division says, for a tree that other points than its own are put in.
    """

    def __init__(self, points: np.ndarray, full, tight: bool):
        self.dim, self.cut, self.kids, self.ranges, self.first, self.last = [], [], [], [], [], []
        self.order = np.arange(len(points))
        lowest, highest = np.iinfo(np.int32).min, np.iinfo(np.int32).max
        stack = [(0, len(points), {}, -1, 0)]
        while stack:
            a, b, known, parent, side = stack.pop()
            node = len(self.dim)
            if parent >= 0:
                self.kids[parent][side] = node
            inside = self.order[a:b]
            found = divided(points[inside]) if full(b - a) else None
            self.first.append(a)
            self.last.append(b)
            if found is None:
                self.dim.append(-1)
                self.cut.append(0)
                self.kids.append([0, 0])
                self.ranges.append([0] * 6)
                continue
            d, t = found
            values = points[inside, d]
            left = values <= t
            self.order[a:b] = np.concatenate([inside[left], inside[~left]])
            least, most = known.get(d, (lowest, highest))
            spans = [(int(values[left].min()), int(values[left].max())), (int(values[~left].min()), int(values[~left].max()))] if tight else [(least, t), (t + 1, most)]
            self.dim.append(d)
            self.cut.append(t)
            self.kids.append([0, 0])
            self.ranges.append([least, most, *spans[0], *spans[1]])
            middle = a + int(left.sum())
            stack.append((a, middle, {**known, d: spans[0]}, node, 0))
            stack.append((middle, b, {**known, d: spans[1]}, node, 1))
        self.dim, self.cut, self.first, self.last = (np.asarray(x, np.int64) for x in (self.dim, self.cut, self.first, self.last))
        self.kids, self.ranges = np.asarray(self.kids, np.int64), np.asarray(self.ranges, np.int64)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            moving = np.flatnonzero(self.dim[node] >= 0)
            if not len(moving):
                return node
            at = node[moving]
            node[moving] = self.kids[at, (points[moving, self.dim[at]] > self.cut[at]).astype(np.int64)]

    def reached(self, points: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves whose box some vector with at most ``more`` letters added and ``less`` taken away lies in."""
        flat, out = points.ravel().astype(np.int64), []
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        up, down = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        while len(q):
            leaf = self.dim[node] < 0
            if leaf.any():
                out.append((q[leaf], node[leaf]))
                q, node, up, down = q[~leaf], node[~leaf], up[~leaf], down[~leaf]
            value = flat[q * points.shape[1] + self.dim[node]]
            least, most, a, b, c, d = self.ranges[node].T
            up, down = up - np.maximum(least - value, 0), down - np.maximum(value - most, 0)
            steps = []
            for side, low, high in ((0, a, b), (1, c, d)):
                plus, minus = up + np.maximum(low - value, 0), down + np.maximum(value - high, 0)
                go = np.flatnonzero((plus <= more) & (minus <= less))
                steps.append((q[go], self.kids[node[go], side], plus[go], minus[go]))
            q, node, up, down = (np.concatenate(x) for x in zip(*steps, strict=True))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def divided(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that divide the points most evenly; None if all are equal."""
    least, most = points.min(0), points.max(0)
    dims = np.flatnonzero(most > least)
    if not len(dims):
        return None
    best, half = (len(points), 0, 0), len(points) / 2
    for t in range(int(least[dims].min()), min(int(most[dims].max()), int(least[dims].min()) + 4)):
        below = (points[:, dims] <= t).sum(0)
        off = np.where((below > 0) & (below < len(points)), np.abs(below - half), len(points))
        i = int(off.argmin())
        best = min(best, (float(off[i]), int(dims[i]), t))
    if best[0] == len(points):  # all the differences lie higher
        d = int(dims[(most - least)[dims].argmax()])
        return d, int((int(least[d]) + int(most[d])) // 2)
    return best[1], best[2]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one code point more, less or replaced makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    apart = np.flatnonzero(x != y[: len(x)])
    same = int(apart[0]) if len(apart) else len(a)
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


class Forest:
    """The upper trees: one for each length up to ``LONG``."""

    def __init__(self, sample: list[bytes], each: int):
        """``each`` is how many words one of the sample stands for."""
        by_length: dict[int, list[bytes]] = {}
        for w in sample:
            by_length.setdefault(min(len(w), LONG), []).append(w)
        empty = Tree(np.zeros((0, LETTERS), np.int32), lambda n: False, False)
        self.trees = [empty] * (LONG + 1)
        for length, words in by_length.items():
            size = sum(map(len, words)) / len(words) * each
            self.trees[length] = Tree(letter_counts(words), lambda n, size=size: n >= FEWEST and n * size > BLOCK, False)

    def visits(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, int, np.ndarray, bool]]:
        """Of words: which of them, tree, leaf, and whether they are visitors (or are placed there)."""
        lengths = np.minimum([len(w) for w in words], LONG)
        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length)
            points = letter_counts([words[i] for i in which])
            yield which, length, self.trees[length].leaf_of(points), False
            at, leaf = self.trees[length].reached(points, 1, 1)
            yield which[at], length, leaf, True
            if length < LONG:
                at, leaf = self.trees[length + 1].reached(points, 1, 0)
                yield which[at], length + 1, leaf, True


def _sizes(forest: Forest):
    """tree, leaf, visitors, size: code points of what a task puts in each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, bool], int] = {}
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            lengths = np.asarray([len(w) for w in words])
            for which, tree, leaf, visitors in forest.visits(words):
                leaves, at = np.unique(leaf, return_inverse=True)
                for x, size in zip(leaves.tolist(), np.bincount(at, lengths[which]).tolist() if len(at) else [], strict=True):
                    total[tree, x, visitors] = total.get((tree, x, visitors), 0) + int(size)
        rows = [(*k, n) for k, n in total.items()]
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], ["tree", "leaf", "visitors", "size"])

    return run


def _dealt(forest: Forest, blocks: dict[tuple[int, int], tuple[int, int]]):
    """Each word once for every block of its leaf's visitors, and as a visitor once for every block of words of the leaves that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            dealt = batch.column("h").to_numpy()
            for which, tree, leaf, visitors in forest.visits(words):
                per_leaf = np.asarray([blocks.get((tree, x), (0, 0)) for x in range(len(forest.trees[tree].dim))], np.int64).reshape(-1, 2)
                nx, ny = per_leaf[leaf].T if len(leaf) else (np.zeros(0, np.int64),) * 2
                go = np.flatnonzero((nx > 0) & (ny > 0))
                which, leaf, nx, ny = which[go], leaf[go], nx[go], ny[go]
                times, own = (nx, ny) if visitors else (ny, nx)
                again = np.repeat(np.arange(len(which)), times)
                step = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                own = dealt[which[again]] % own[again]
                x, y = (step, own) if visitors else (own, step)
                rows = pa.array(which[again])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(rows), batch.column("n").take(rows), pa.array(np.full(len(again), tree, np.int32)), pa.array(leaf[again].astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(np.full(len(again), visitors))],
                    ["word", "n", "tree", "leaf", "x", "y", "visitor"],
                )

    return run


def _verified(asked: list[bytes], held: list[bytes], q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of the pairs differ by one edit. All of ``held`` have one length unless they are long."""
    out = np.zeros(len(q), bool)
    lengths = np.asarray([len(w) for w in asked], np.int64)
    size = len(held[0])
    if size >= LONG:
        for i, (a, b) in enumerate(zip(q.tolist(), p.tolist(), strict=True)):
            out[i] = one_edit(asked[a], held[b])
        return out
    right = np.frombuffer(b"".join(held), np.uint8).reshape(-1, size)
    for length in (size, size - 1):
        pairs = np.flatnonzero(lengths[q] == length)
        if len(pairs):
            own, at = np.unique(q[pairs], return_inverse=True)
            x, y = np.frombuffer(b"".join(asked[i] for i in own), np.uint8).reshape(-1, length)[at], right[p[pairs]]
            if length == size:
                out[pairs] = (x != y).sum(1) == 1
            else:
                ahead = np.logical_and.accumulate(x == y[:, :-1], 1).sum(1)
                behind = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], 1).sum(1)
                out[pairs] = ahead + behind >= length
    return out


def _near_in_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """word, n, near, near_n of the words of one block and the visitors of one block of its leaf."""
    tree = key[0].as_py()
    visitor = rows.column("visitor").to_numpy()
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    held_at, asked_at = np.flatnonzero(~visitor), np.flatnonzero(visitor)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(held_at) and len(asked_at):
        held = [words[i] for i in held_at]
        points = letter_counts(held)
        local = Tree(points, lambda n: n > BUCKET, True)
        parity = lambda counts: np.bitwise_xor.reduce((counts & 1).astype(np.uint64) * BIT, axis=1)
        signs = parity(points)
        shorter = np.asarray([len(words[i]) < tree for i in asked_at])
        for few, less in ((shorter, 0), (~shorter, 1)):
            group = asked_at[few]
            for a in range(0, len(group), TOGETHER):
                part = group[a : a + TOGETHER]
                asked = [words[i] for i in part]
                counts = letter_counts(asked)
                q, leaf = local.reached(counts, 1, less)
                size = local.last[leaf] - local.first[leaf]
                again = np.repeat(np.arange(len(q)), size)
                p = local.order[local.first[leaf][again] + np.arange(len(again)) - np.repeat(np.cumsum(size) - size, size)]
                q = q[again]
                close = np.bitwise_count(parity(counts)[q] ^ signs[p]) <= 2
                q, p = q[close], p[close]
                if len(q):
                    good = _verified(asked, held, q, p)
                    found.append((part[q[good]], held_at[p[good]]))
    one, two = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    # a longer word isn't a visitor of shorter ones, so its pair is put out from here as well
    both = np.asarray([len(words[i]) < tree for i in one], bool)
    one, two = np.concatenate([one, two[both]]), np.concatenate([two, one[both]])
    word, n = rows.column("word"), rows.column("n")
    return pa.table([word.take(pa.array(one)), n.take(pa.array(one)), word.take(pa.array(two)), n.take(pa.array(two))], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every two different words of ``words`` (word, n: each word once) that are one edit apart, both ways round."""
    each = max(1, -(-words.count() // SAMPLE))
    h = F.xxhash64("word").bitwiseAND((1 << 62) - 1)
    sample = words.where(h % each == 0).select("word").toArrow().column("word").to_pylist()
    forest = Forest(sorted(w.encode("latin-1") for w in sample), each)
    sizes = words.select("word").mapInArrow(_sizes(forest), "tree int, leaf int, visitors boolean, size long").groupBy("tree", "leaf", "visitors").agg(F.sum("size").alias("size"))
    blocks: dict[tuple[int, int], tuple[int, int]] = {}
    for r in sizes.collect():  # two rows for each leaf at most, and SAMPLE and FEWEST bound the leaves
        nx, ny = blocks.get((r["tree"], r["leaf"]), (0, 0))
        blocks[r["tree"], r["leaf"]] = (nx, -(-r["size"] // VISITORS)) if r["visitors"] else (-(-r["size"] // BLOCK), ny)
    dealt = words.select("word", "n", F.shiftright(h, 24).alias("h")).mapInArrow(_dealt(forest, blocks), "word string, n long, tree int, leaf int, x int, y int, visitor boolean")
    return dealt.groupBy("tree", "leaf", "x", "y").applyInArrow(_near_in_block, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) from each word ends. Steps double, so rounds grow with the logarithm of the longest way."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        seen = Observation()
        moved = state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = cut_lineage(moved.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")).select("word", "root"))
        forget(state)
        state = after
        if not seen.get["moved"]:
            return state


def spelling_groups(docs: DataFrame, ratio: int = 10, min_length: int = 7, min_count: int = 2, erased: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word.

    The form is the near word of largest count (of equals the first in code-point order) if it occurs at least ``ratio`` times as often; the root
    is where forms lead to in the end.
    """
    words = cut_lineage(word_counts(docs, min_length, min_count, erased, id_col, text_col))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    named = cut_lineage(near.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    ends = roots(named.where(F.col("form").isNotNull()).select("word", "form"))
    out = words.join(named, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
