"""Held-out accuracy, the kernel against its definition, and odd rows."""

import zlib

import numpy as np
from conftest import SMALL

from sitegrain.llm import language


def grams(text):
    """The n-grams themselves, by definition."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    c = " " + " ".join(letters.split()) + (" " if letters and letters[-1] == " " else "")
    return {c[i : i + n] for n in (1, 2, 3) for i in range(len(c) - n + 1)}


def test_kernel_counts_shared_ngrams():
    texts = ["Der Hund  läuft.", "the dog, runs!", "Ñandú 12 x", "a", "aaaa bbbb"]
    found = [language.ngrams(t) for t in texts]
    assert [len(f) for f in found] == [len(grams(t)) for t in texts]
    model = language.train(found, ["de", "en", "es", "en", "de"])
    k = model.kernel(found)
    names = ["de", "en", "es", "en", "de"]
    turns = [0, 1, 2, 4, 3]
    want = [[len(grams(a) & grams(texts[j])) / (len(grams(a)) * len(grams(texts[j]))) ** 0.5 for j in turns] for a in texts]
    assert np.allclose(k, want, atol=1e-6) and model.languages == sorted(set(names))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.9 * len(tested)


def test_only_text_decides(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    model = language.fit(docs)
    other = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'y' AS source")
    assert sorted((r.doc_id + 1000000, r.lang_pred, r.score) for r in language.predict(docs, model).collect()) == sorted(map(tuple, language.predict(other, model).collect()))


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score string"
    rows = [(1, "der die das und nicht", "de"), (2, "the and of to in", "en"), (3, None, "en"), (4, "", None), (5, "123 .,!", "en"), (6, "the " * 60_000, None), (None, "und der", "de"), (1, "der die das und nicht", "de"), (8, "ᚠ", None)]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identify(spark.createDataFrame([(*r, "", "") for r in rows], schema)).collect())
    assert [g for g in got if g[0] not in (8,)] == [(0, "de"), (1, "de"), (1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    empty = spark.createDataFrame([], schema)
    assert language.identify(empty).count() == 0
    unlearned = language.identify(spark.createDataFrame([(1, "abc", None, "", "")], schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlearned] == [("und", 0.0)]
