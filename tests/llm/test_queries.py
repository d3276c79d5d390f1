"""Queries against their SQL, and the pipeline against what its stages must do."""

import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F
from test_near_dups import expected
from test_personal_data import plain
from tokenizers import Tokenizer

import corpus_pipeline
from sitegrain.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", ["op2_html_text", "op4_pieces", "op5_token_counts", "op9_packing", "op10_language"])
def test_other_queries_cover_their_tables(spark, name):
    table, key = ("pages", "page_id") if name == "op2_html_text" else ("documents", "doc_id")
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
    assert QUERIES[name](spark, SMALL).select(key).distinct().count() == rows.count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(9001, None, "en", "x", 0), (9002, "12 34", None, "x", 5), (9003, "", "en", "x", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("kept", F.lit("clash"))
    rows = {r.doc_id: r for r in docs.collect()}
    language, dedup, private, packing = (f for _, f in corpus_pipeline.STAGES)

    first = language(spark, docs, SMALL)
    assert first.columns == docs.columns
    kept = {r.doc_id: r for r in first.collect()}
    assert set(rows) - set(kept) == {9001, 9002, 9003} and all(kept[i] == rows[i] for i in kept)

    second = dedup(spark, first, SMALL)
    assert second.columns == docs.columns
    groups = expected([(i, r.text) for i, r in kept.items()], 5)
    left = {r.doc_id: r for r in second.collect()}
    assert set(left) == {i for i, (_, _, stays) in groups.items() if stays}

    third = private(spark, second, SMALL)
    assert third.columns == docs.columns
    clean = {r.doc_id: r for r in third.collect()}
    assert set(clean) == set(left)
    for i, r in clean.items():
        assert not plain(r.text) and r.n_chars == len(r.text) and (r.source, r.lang, r.kept) == (left[i].source, left[i].lang, left[i].kept)
        assert plain(left[i].text) or "[" in r.text or r.text == left[i].text

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in packing(spark, third, SMALL).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, r in clean.items():
        ids = [x for p in sorted(pieces[i], key=lambda p: p.start) for x in np.frombuffer(bytes(p.ids), "<u4")]
        assert ids == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]


def test_edges_of_stages(spark):
    """No language to learn from, ids that are repeated or missing, repeated rows."""
    language, dedup = (f for _, f in corpus_pipeline.STAGES[:2])
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    copy, own = " ".join(words), " ".join(reversed(words))
    rows = [(1, copy), (2, copy), (2, own), (3, "12 34"), (4, None), (5, "a text of its own, quite unlike all others here"), (5, "a text of its own, quite unlike all others here"), (None, "copies without any id are copies as well"), (None, "copies without any id are copies as well")]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string").coalesce(1)
    first = language(spark, docs, SMALL)
    assert sorted((r.text for r in first.collect())) == sorted(t for _, t in rows if t and t != "12 34")
    assert sorted((r.doc_id or 0, r.text) for r in dedup(spark, first, SMALL).collect()) == sorted((i or 0, t) for i, t in [rows[0], rows[2], rows[5], rows[7]])


def test_empty_documents_run_through(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_nothing_else_imports_the_subpackage():
    code = "import sys, json; import sitegrain.plans, sitegrain.streaming, sitegrain.sources.sinks; print(json.dumps([m for m in sys.modules if m.startswith('sitegrain.llm')]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert json.loads(out.stdout.splitlines()[-1]) == []
