"""Ids and texts against the sentencepiece library, for the public BPE model and small unigram models put together by hand."""

import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegrain.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " a", "a ", "  a  b  ", "a\nb\t c", "▁x y", "<s> </s> <unk> <0x0A>", "日本語 ünï", "\x00 x", "😀 👍🏽 a", "a  ", " ", "   ", "a" * 30, "w " * 4000, "." * 20]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PATH)


def same(codec, texts):
    found = codec.encode(texts)
    want = codec.reference.encode(texts)
    assert [np.frombuffer(b, "<i4").tolist() for b, _ in found] == want
    assert codec.decode([np.asarray(w, int) for w in want]) == [codec.reference.decode(w) for w in want]
    return [ok for _, ok in found]


def test_fixed_texts(codec):
    assert codec.model.by_word and all(same(codec, ODD))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n▁aeést<>"), st.characters(codec="utf-8", exclude_characters="\0")), max_size=30), max_size=4))
def test_any_text(texts):
    same(pieces.codec(PATH), texts)


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            assert len(value) < 128
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


@pytest.mark.parametrize(("leading", "trim", "fallback"), [(1, 1, 0), (1, 0, 1), (0, 0, 0), (0, 1, 1)])
def test_unigram(tmp_path, leading, trim, fallback):
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    listed += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else []
    listed += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "é", "bb", "a▁b"])]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in listed)
    data += message((2, message((3, 1), (35, fallback))), (3, message((1, b"identity"), (3, leading), (4, trim), (5, 1))))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    own = pieces.Codec(str(path))
    texts = ["ab", "abab", " a b ", "aba  b", "éab b", "", "ba bab abba", "b a"]
    assert own.model.kind == pieces.UNIGRAM and not own.model.by_word
    want = own.reference.encode(texts)
    assert [np.frombuffer(b, "<i4").tolist() for b, _ in own.encode(texts)] == want and own.backend_ids(texts) == want


def test_frames(spark):
    rows = [*enumerate(ODD), (3, "a "), (None, "x y"), (99, None)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    encoded = pieces.encode(docs, PATH)
    own = pieces.codec(PATH)
    for r in encoded.collect():
        if r.doc_id is not None:
            text = dict(rows)[r.doc_id]
            assert (r.ids, r.parity) == ((None, None) if text is None else (own.reference.encode(text), True))
    decoded = {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()}
    assert decoded[99] is None and all(decoded[i] == own.reference.decode(own.reference.encode(t)) for i, t in enumerate(ODD))
    assert all(r.decoded == decoded[r.doc_id] for r in pieces.encode_and_decode(docs, PATH).collect())
    assert pieces.encode(docs.limit(0), PATH).count() == 0
