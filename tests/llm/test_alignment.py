"""Alignment of two tokenizations against whole texts encoded at once, and the laws of its fragments."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sitegrain.llm import alignment
from sitegrain.llm.alignment import Fragment, folded

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_force(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each row, by encoding every text whole."""
    a_model, b_model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    # the printable stand-ins of bytes, as byte-level vocabularies define them
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    found = []
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False) if text else None
        a_ids, a_bytes = (a.ids, [bytes(byte_of[c] for c in t) for t in a.tokens]) if text else ([], [])
        b_ids = b_model.encode(text) if text else []
        names = [b_model.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, names)]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append((doc, 0, 0, [], ""))
            continue
        i = j = x = y = 0
        groups, links, group = [], [], ([], [])
        while i < len(a_ids) or j < len(b_ids):
            if x <= y:
                x += len(a_bytes[i])
                group[0].append(a_ids[i])
                i += 1
            else:
                y += len(b_bytes[j])
                group[1].append(b_ids[j])
                j += 1
            if x == y:
                groups.append(group)
                links.append((group[0][-1], group[1][-1]))
                group = ([], [])
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((doc, len(a_ids), len(b_ids), links, hashlib.sha256(said.encode()).hexdigest()))
    counts = Counter(pair for row in found for pair in row[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(((d, na, nb, len(ls), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, ls, sha in found), key=repr)


def result(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a\n \nb\n\nc\t d \n"), (6, "\n"), (7, "▁ marks ▁"), (8, "<s> <|endoftext|> </s> <0x41>"), (9, "naïve façade  x 　日本語のテキスト 🙂🙂 é"),
    (10, "a.\nB c.\nD"), (10, "a.\nB c.\nD"), (None, "no id"), (11, "x" * 3000), (12, "\0 \x1c y\x85z"), (13, "don't can't 12345 3.14"), (14, "Ünïcödé words line"),
]


@pytest.mark.parametrize("chunk", [65_536, 40])
def test_all_rows_against_brute_force(spark, chunk):
    """Ranges of forty bytes put nearly all texts through the tree of fragments."""
    random.seed(5)
    words = ["the", "of", "straße", "tokenization", "日本", "x1", "it's", "end.\nNext", "a\tb", "e.g.,", "(see", "10%)"]
    rows = ODD + [(100 + i, " ".join(random.choices(words, k=random.randrange(1, 60)))) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row string").repartition(3)
    assert result(alignment.aligned_links(docs, A, B, chunk=chunk, fan=3)) == brute_force(rows)


def test_many_slices_of_counts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 5)
    rows = [(i, f"some words {i} and the rest of them") for i in range(30)]
    assert result(alignment.aligned_links(spark.createDataFrame(rows, "doc_id long, text string"), A, B)) == brute_force(rows)


def test_empty_table(spark):
    assert result(alignment.aligned_links(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


def test_fragments_compose_in_any_order():
    """Any way of cutting the byte range and of bracketing gives the same groups."""
    own = alignment.Aligner(A, B)
    text = " tokenization of naïve 日本語 strings, 12345 times"
    found = own.stretch(text)
    size = len(text.encode())
    want = found.fragment(0, size).whole()
    assert want and want.count(";") + 1 == len(found.common)
    random.seed(2)
    for _ in range(50):
        cuts = [0, *sorted(random.sample(range(1, size), 6)), size]
        parts = [found.fragment(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        left = Fragment()
        for p in parts:
            left = left.then(p)
        right = Fragment()
        for p in reversed(parts):
            right = p.then(right)
        assert left == right == folded(parts) and left.whole() == want
        assert folded([Fragment(), *parts, Fragment()]) == left


def test_long_text_is_cut_at_safe_places():
    own = alignment.Aligner(A, B)
    text = " " + "some wörds\nof it. " * 20 + "y" * 200
    cut = list(own.ranges(text, 50))
    assert "".join(t for _, t in cut) == text and all(at == len("".join(t for _, t in cut[:i]).encode()) for i, (at, _) in enumerate(cut))
    assert all(len(t.encode()) <= 50 for _, t in cut[:-1])
    assert [i for _, t in cut for i in own.stretch(t).a.tolist()] == own.stretch(text).a.tolist()
