"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of orders 1 to 3, over lower-cased letters with every run of other characters as one
space; n-grams are hashed. The kernel of two texts is the number of n-grams in both, over the root of the product of how many each
has. Some training texts serve as Nystrom landmarks: the kernel to them, through the inverse root of the kernel among them, gives
features whose inner products approximate the kernel, and a ridge regression against one language and the rest is solved on them.
All of it folds into one matrix, so that texts are scored in batches by two matrix products. Whole texts are read.

Bounded: the training sample, ``PER_LANGUAGE`` rows of each language (smallest hashes), and ``LANDMARKS`` among them.

Defined results: ``und`` with score 0 for a null text, a text without letters, or where no language could be learned. Of equal scores,
the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.llm.common import bytes_of, own_columns, slices

#: Training rows of each language and landmarks in all, at most.
PER_LANGUAGE, LANDMARKS = 300, 96
ORDERS, BUCKETS, RIDGE, BATCH = 3, 1 << 17, 1e-2, 256

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _tables:
        _tables.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _tables[0]


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of a whole text; none without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    c = np.concatenate([[0], np.where(letter, c, 0)[keep]]).astype(np.uint32)
    present = np.zeros(BUCKETS, bool)
    h = np.zeros(len(c), np.uint32)
    for order in range(1, min(ORDERS, len(c)) + 1):
        h = h[: len(c) - order + 1] * np.uint32(0x01000193) + c[order - 1 :] + np.uint32(order)
        present[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17)] = True
    return np.flatnonzero(present)


@dataclass
class Model:
    """``columns`` numbers the n-grams of landmarks, ``landmarks`` says which each has, ``weights`` takes kernels to languages."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(grams), self.landmarks.shape[1]), np.float32)
        for row, g in zip(x, grams, strict=True):
            at = self.columns[g]
            row[at[at >= 0]] = 1
        n = np.maximum([len(g) for g in grams], 1)
        return (x @ self.landmarks.T) / np.sqrt(np.outer(n, self.sizes))

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """About 1 for a text's language and -1 for others."""
        return self.kernel(grams) @ self.weights + self.bias


def train(grams: list[np.ndarray], names: list[str]) -> Model:
    """Kernel ridge regression, each language against the rest."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.full(BUCKETS, -1), np.zeros((0, 0), np.float32), np.ones(0), np.zeros((0, 0)), np.zeros(0))
    by = [[i for i, n in enumerate(names) if n == language] for language in languages]
    turns = [own[t] for t in range(max(map(len, by))) for own in by if t < len(own)]  # the languages in turn
    chosen = turns[:LANDMARKS]
    known = np.unique(np.concatenate([grams[i] for i in chosen]))
    columns = np.full(BUCKETS, -1)
    columns[known] = np.arange(len(known))
    landmarks = np.zeros((len(chosen), len(known)), np.float32)
    for row, i in zip(landmarks, chosen, strict=True):
        row[columns[grams[i]]] = 1
    model = Model(languages, columns, landmarks, np.asarray([len(grams[i]) for i in chosen], float), np.zeros((0, 0)), np.zeros(0))
    values, vectors = np.linalg.eigh(model.kernel([grams[i] for i in chosen]).astype(float))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = model.kernel(grams) @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    weight = np.asarray([len(names) / (len(languages) * len(by[languages.index(n)])) for n in names])[:, None]
    target = np.where(np.asarray(names)[:, None] == np.asarray(languages)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ (features * weight) + RIDGE * np.eye(features.shape[1]), features.T @ (target * weight))
    model.weights, model.bias = root @ solved[:-1], solved[-1]
    return model


def held_out(id_col: Column) -> Column:
    """Rows that are kept out of training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngrams(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.list_(pa.int64()))], ["lang", "grams"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows that have an id, a language and a letter and aren't held out."""
    rows = own_columns(docs, id=id_col, text=text_col, lang=lang_col).where(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select(F.col("id").cast("string").alias("id"), "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").withColumn("at", F.row_number().over(order)).where(F.col("at") <= PER_LANGUAGE).select("id", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).dropDuplicates(["id", "lang"]).select("id", "lang", "text")
    found = sample.orderBy("lang", "id").select("lang", "text").mapInArrow(_grams, "lang string, grams array<long>").toArrow()
    grams, names = [np.asarray(g, np.int64) for g in found.column("grams").to_pylist()], found.column("lang").to_pylist()
    full = [i for i, g in enumerate(grams) if len(g)]
    return train([grams[i] for i in full], [names[i] for i in full])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for start, stop in slices(offsets):
                grams = [ngrams(t) for t in batch.column("text").slice(start, stop - start).to_pylist()]
                names, scores = ["und"] * len(grams), np.zeros(len(grams))
                full = [i for i, g in enumerate(grams) if len(g)] if model.languages else []
                for a in range(0, len(full), BATCH):
                    part = full[a : a + BATCH]
                    f = model.scores([grams[i] for i in part])
                    best = f.argmax(1)
                    for i, b, s in zip(part, best.tolist(), f.max(1).tolist(), strict=True):
                        names[i], scores[i] = model.languages[b], min(1.0, max(0.0, (1 + s) / 2))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, stop - start), pa.array(names), pa.array(scores)], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row; only the text decides."""
    rows = own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", "doc_id")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, by a model of the rows that aren't held out."""
    found = predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _kept(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            _, offsets = bytes_of(batch.column(at))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                named = pa.RecordBatch.from_arrays([pa.nulls(b - a), part.column(at)], ["id", "text"])
                found = pa.concat_arrays([x.column("lang_pred") for x in _predict(model)([named])])
                yield part.filter(pa.array([x != "und" for x in found.to_pylist()], pa.bool_()))

    return run


def where_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a language of the model."""
    return docs.mapInArrow(_kept(model, text_col), docs.schema)
