"""Cross-entropy difference of documents under two matched n-gram models.

The background model counts all documents and the target model those that are chosen. Tokens are the characters of whole texts, and each is
predicted from the three before it (a start sign where there are none). The models are matched: one vocabulary, the characters of
the background, and one smoothing, in which each order is mixed with the next lower one as a prior of ``PRIOR`` counts:
``p(c | h) = (n(h c) + PRIOR * p(c | shorter h)) / (n(h) + PRIOR)``, down to the uniform distribution over the vocabulary. A document's
score is the mean over its tokens of the loss under the target minus the loss under the background; low is like the target.

Counts are made in the tasks by sorting packed n-grams, added up by Spark and smoothed by joins of orders; nothing of them is cut off. Only
texts that may be chosen, by a bitmap of ``MARKS`` bits, are moved to meet the chosen ids. To score, the table of losses goes to the workers in
slices of about ``SENT`` rows, each in a pass of its own over the texts, and a document's sums are added up; a worker never holds more than a slice.
The documents are read in each pass, so pass a table or a written frame.

Defined results: a null or empty text has no tokens and null losses. Every code point, U+0000 as well, is a character of its own; the start sign lies outside
of Unicode. Without any chosen document the target model is uniform. Repeated rows count again and each has its score; a null id is carried along. A text is
never cut: a worker needs some thirty bytes for each of its characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import bytes_of, own_columns, slices
from sitegrain.session import cut_lineage

ORDER, PRIOR = 4, 10.0
#: Rows of the table of losses, of 28 bytes each, that are sent to workers at a time.
SENT = 4_000_000
#: Bits of the bitmap of chosen ids, two for each. With ten million ids it lets one text in fifteen through for nothing.
MARKS = 1 << 26
#: Bits of a code point; the three of a history fit in a long. The start sign is the first number beyond Unicode.
BITS, START = 21, 0x110000


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that each character ends, as the three before it in one number and itself, text after text, and how many each text has."""
    lengths = np.asarray([len(t or "") for t in texts])
    joined = "".join("\0\0\0" + (t or "") for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = np.ones(len(c), bool)
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    for i in range(ORDER - 1):
        inside[starts + i] = False
    c[~inside] = START
    histories = np.zeros_like(c)
    for back in range(1, ORDER):
        histories[back:] |= c[:-back] << (BITS * (back - 1))
    return histories[inside], c[inside].astype(np.int32), lengths


def narrow(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as four 16-bit codes in one number, and which of them it is right for: those of the basic plane."""
    m, key, wide = (1 << BITS) - 1, c.astype(np.int64), c.astype(np.int64)
    for i in range(ORDER - 1):
        code = (h >> (BITS * i)) & m
        key |= code << (16 * (i + 1))
        wide |= code
    return key, wide < 1 << 16


def added_up(h: np.ndarray, c: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram once, with the sum of its numbers."""
    key, plane = narrow(h, c)
    n = np.ones(len(h), np.int64) if n is None else n
    k, at = np.unique(key[plane], return_inverse=True)
    unpacked = sum((((k >> (16 * (i + 1))) & 0xFFFF) << (BITS * i) for i in range(ORDER - 1)), np.zeros(len(k), np.int64))
    out = [(unpacked, (k & 0xFFFF).astype(np.int32), np.bincount(at, n[plane], len(k)).astype(np.int64))]
    if not plane.all():
        bh, bc, bn = h[~plane], c[~plane], n[~plane]
        order = np.lexsort((bc, bh))
        bh, bc, bn = bh[order], bc[order], bn[order]
        first = np.flatnonzero(np.r_[True, (bh[1:] != bh[:-1]) | (bc[1:] != bc[:-1])])
        out.append((bh[first], bc[first], np.add.reduceat(bn, first)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of a task and their numbers, added up as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    added = lambda: added_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
    rows = lambda grams: pa.RecordBatch.from_arrays([pa.array(x) for x in grams], ["h", "c", "n"])
    for batch in batches:
        _, offsets = bytes_of(batch.column("text"))
        for a, b in slices(offsets):
            held.append(added_up(*packed(batch.column("text").slice(a, b - a).to_pylist())[:2]))
            if len(held) == 16:
                held[:] = [added()]
                if len(held[0][0]) > 2_000_000:
                    yield rows(held.pop())
    if held:
        yield rows(added())


def _smoothed(grams: DataFrame) -> DataFrame:
    """h, c, target_loss, background_loss of each n-gram, from the counts ``nb`` and ``nt``."""
    low = lambda k: F.col("h").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1).cast("long"))
    sums = (F.sum("nb").alias("nb"), F.sum("nt").alias("nt"))
    level = {k: cut_lineage(grams.select(low(k).alias("h"), "c", "nb", "nt").groupBy("h", "c").agg(*sums)) if k < ORDER else grams for k in range(1, ORDER + 1)}
    whole = level[1].agg(F.sum("nb").alias("hb"), F.sum("nt").alias("ht"), F.count("*").alias("v"))
    mixed = lambda n, below, h: (F.col(n) + PRIOR * F.col(below)) / (F.col(h) + PRIOR)
    p = level[1].withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one").withColumn("u", 1.0 / F.col("v"))
    p = p.select("h", "c", mixed("nb", "u", "hb").alias("pb"), mixed("nt", "u", "ht").alias("pt"))
    for k in range(2, ORDER + 1):
        own = level[k].withColumn("shorter", low(k - 1))
        history = own.groupBy("h").agg(F.sum("nb").alias("hb"), F.sum("nt").alias("ht"))
        below = p.select(F.col("h").alias("shorter"), "c", F.col("pb").alias("lb"), F.col("pt").alias("lt"))
        p = own.join(history, "h").join(below, ["shorter", "c"]).select("h", "c", mixed("nb", "lb", "hb").alias("pb"), mixed("nt", "lt", "ht").alias("pt"))
    return p.select("h", "c", (-F.log("pt")).alias("target_loss"), (-F.log("pb")).alias("background_loss"))


def _marked(bits: np.ndarray):
    """The rows whose two bits are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column(c).to_numpy() for c in ("one", "two")]
            hit = np.flatnonzero(np.logical_and(*(bits[x >> 3] >> (x & 7) & 1 for x in both)))
            yield batch.take(pa.array(hit)).select(["id", "text"])

    return run


def chosen_texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of ``rows`` (id, text) whose id is in the column of ``chosen``. A bitmap leaves out nearly all others before any text moves."""
    ids = chosen.toDF("id").where("id IS NOT NULL").distinct()
    place = lambda shift: F.pmod(F.shiftrightunsigned(F.xxhash64("id"), shift), F.lit(MARKS))
    at = ids.select(F.explode(F.array(place(0), place(32))).alias("at")).select((F.col("at") + 1).alias("at"))
    pages = at.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(MARKS // 8, np.uint8)
    for r in pages.collect():  # MARKS bits in pages of 4,096 bytes at most
        page = np.frombuffer(r["bits"], np.uint8)
        bits[(r["page"] - 1) * len(page) : r["page"] * len(page)] = page
    maybe = rows.select("id", "text", place(0).alias("one"), place(32).alias("two")).mapInArrow(_marked(bits), f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return maybe.join(ids.hint("merge"), "id", "left_semi").select("text")


def losses(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h (the three characters before), c, target_loss, background_loss of every n-gram of ``docs``; the target model counts the rows whose id is in the column of ``chosen``."""
    rows = own_columns(docs, id=id_col, text=text_col)
    count = lambda texts, name: texts.mapInArrow(_counted, "h long, c int, n long").groupBy("h", "c").agg(F.sum("n").alias(name))
    grams = count(rows.select("text"), "nb").join(count(chosen_texts(rows, chosen), "nt"), ["h", "c"], "left").fillna(0, ["nt"])
    return cut_lineage(_smoothed(cut_lineage(grams)))


class Table:
    """Finds the rows of many n-grams: a first guess by hash, a search where it fails."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, int(4 * len(keys)).bit_length()))
        self.slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slot[self._hash(self.keys)] = np.arange(len(keys))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; zeros for keys that aren't there."""
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]))
        at = self.slot[self._hash(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.minimum(np.searchsorted(self.keys, keys[wrong]), len(self.keys) - 1)
        found = self.values[at]
        found[wrong[self.keys[at[wrong]] != keys[wrong]]] = 0
        return found


class Grams:
    """Losses of n-grams: by one number in the basic plane, else by the place of the history and the character."""

    def __init__(self, h: np.ndarray, c: np.ndarray, values: np.ndarray):
        key, plane = narrow(h, c)
        self.basic = Table(key[plane], values[plane])
        histories = np.unique(h[~plane])
        self.places = Table(histories, np.arange(1, len(histories) + 1)[:, None])
        self.others = Table(self._other(h[~plane], c[~plane]), values[~plane])

    def _other(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.places.find(h)[:, 0].astype(np.int64) << BITS | c

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        key, plane = narrow(h, c)
        if plane.all():
            return self.basic.find(key)
        out = np.zeros((len(h), 2))
        out[plane], out[~plane] = self.basic.find(key[plane]), self.others.find(self._other(h[~plane], c[~plane]))
        return out


_tables: dict[str, Grams] = {}


def _scored(sent, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tables:  # a worker keeps one table
            _tables.clear()
            _tables[name] = Grams(*sent.value)
        find = _tables[name].find
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets):
                h, c, lengths = packed(batch.column("text").slice(a, b - a).to_pylist())
                loss, full = find(h, c), lengths > 0
                sums = np.zeros((b - a, 2))
                if full.any():
                    sums[full] = np.add.reduceat(loss, (np.cumsum(lengths) - lengths)[full], axis=0)
                own = [batch.column(n).slice(a, b - a) for n in ("row", "id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lengths, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["row", "id", "n_tokens", "t", "b"])

    return run


def score(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of each row, by the losses of documents it was among. Losses are per token."""
    context, rows = docs.sparkSession.sparkContext, own_columns(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    parts = max(1, -(-table.count() // SENT))
    sums = None
    for part in range(parts):
        local = table.where(F.pmod(F.xxhash64("h", "c"), F.lit(parts)) == part).toArrow()  # about SENT rows
        values = np.stack([local.column(c).to_numpy() for c in ("target_loss", "background_loss")], 1)
        sent = context.broadcast((local.column("h").to_numpy(), local.column("c").to_numpy(), values))
        found = cut_lineage(rows.mapInArrow(_scored(sent, uuid.uuid4().hex), f"row long, id {kind}, n_tokens long, t double, b double"))
        sent.unpersist()
        sums = found if sums is None else sums.union(found)
    summed = sums.groupBy("row").agg(F.first("id").alias("id"), F.first("n_tokens").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return summed.select(F.col("id").alias("doc_id"), "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("score"))


def cross_entropy_difference(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all rows under the models of all rows and of those whose id is in ``chosen``."""
    return score(docs, losses(docs, chosen, id_col, text_col), id_col, text_col)
