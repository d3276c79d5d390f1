"""Encoding, packing and flat token files against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitegrain.llm import packing, token_counts
from sitegrain.llm.bpe import Encoder
from sitegrain.session import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "  ", "a", "a b", "a  b", " a", "a \n b", "a\n", "tail ", "x<|endoftext|>y z", "don't 's it''s 12 3", "é  ü", "日本 語", "\x00 \x1f   a", "w" * 3000, "hello world, " * 3000]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  'sdé1<>|"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_words_encode_as_the_whole(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH).encode(texts)] == [ids_of(t) for t in texts]


def test_fixed_texts_encode_as_the_whole():
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH).encode([t or "" for t in TEXTS])] == [ids_of(t) for t in TEXTS]


def test_balance_fills_every_sequence():
    r = random.Random(5)
    for _ in range(30):
        sizes = [r.choice([0, 1, 3, r.randint(1, 1023)]) for _ in range(r.randint(1, 80))]
        sequences = packing.balance(sizes, 1024, 4096)
        spans = sorted((d, s, n) for q in sequences for d, s, n in q)
        for doc, size in enumerate(sizes):
            at = 0
            for _, start, n in (x for x in spans if x[0] == doc):
                assert start == at and n > 0
                at += n
            assert at == size
        assert all(t == 1024 or t & (t - 1) == 0 for t in (sum(n for _, _, n in q) for q in sequences))


def test_costs_are_balanced():
    r = random.Random(6)
    sequences = packing.balance([r.randint(1, 1023) for _ in range(4000)], 1024, 64)
    costs = [sum(packing.piece_cost(n, 64) for _, _, n in q) for q in sequences if sum(n for _, _, n in q) == 1024]
    assert max(costs) < 1.5 * sum(costs) / len(costs)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 2000)
    rows = [*enumerate(TEXTS), (3, "  "), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(3)
    out = packing.pack(docs, PATH).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        want = [*ids_of(text), 0]
        pieces = sorted(by_id[i], key=lambda r: (r.start, r.sequence_id))
        if i != 3:
            assert [x for p in pieces for x in np.frombuffer(bytes(p.ids), "<u4")] == want
            assert all(p.doc_tokens == len(want) and p.length == len(p.ids) // 4 for p in pieces)
            assert zlib.crc32(np.asarray(want, "<u4").tobytes()) == zlib.crc32(b"".join(bytes(p.ids) for p in pieces))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize(("width", "block"), [(2, 4 << 20), (2, 6), (4, 64)])
def test_flat_files(spark, width, block):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, row int").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs, PATH, 50256, width, block).collect()}
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert token_counts.document_token_counts(docs.limit(0), PATH, 50256).count() == 0


def test_unclosed_and_empty_files(spark):
    folder = f"{shared_folder(spark)}/flat-{random.random()}"
    store, inside = token_counts._open(folder)
    store.create_dir(inside, recursive=True)
    for name, ids in {"a.bin": [9, 9, 5, 5, 9, 1], "b.bin": [], "c.bin": [9], "d.bin": [1, 2, 3]}.items():
        with store.open_output_stream(f"{inside}/{name}") as out:
            out.write(np.asarray(ids, "<u2").tobytes())
    got = sorted((r.file, r.row, r.start, r.n_tokens, r.closed) for r in token_counts.count_tokens(spark, folder, 9, 2, 4).collect())
    assert got == [("a.bin", 0, 0, 0, True), ("a.bin", 1, 1, 0, True), ("a.bin", 2, 2, 2, True), ("a.bin", 3, 5, 1, False), ("c.bin", 0, 0, 0, True), ("d.bin", 0, 0, 3, False)]
