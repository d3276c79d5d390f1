"""SentencePiece encoding and decoding by the ``tokenizers`` library.

The model file, a protocol buffer, is read here: pieces with scores and kinds, and the trainer's and normaliser's settings that decide
ids. From them the backend is rebuilt: the precompiled normaliser, removal of extra white space, the metaspace marker with or without
the leading one, a unigram model with its scores or a BPE model whose merges are the ways to make each piece of two others, by
descending score, byte fallback, and a decoder that reverses all of it.

Where no piece holds a marker behind another character, no id reaches over the start of a word, so each distinct word is encoded
once in a worker, in multithreaded batches. Each such word, and each text that has to be encoded whole, is also encoded by
``sentencepiece``; texts whose ids differ say so and get the ids of ``sentencepiece``.

Defined results: a null text has null ids and decodes to null; an empty text has no ids.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from sitegrain.llm.bpe import TOGETHER, Memory, cut_at
from sitegrain.llm.common import bytes_of, own_columns, slices

MARK = "▁"
# Fixed values of the model format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.charsmap = UNIGRAM, False, b""
        self.leading, self.trim, self.escape, self.suffix = True, True, True, False
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                self.kind, self.byte_fallback, self.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
            elif number == 3:
                own = dict(fields(value))
                self.charsmap = own.get(2, b"")
                self.leading, self.trim, self.escape = (bool(own.get(n, 1)) for n in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with a marker before words are known")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        #: No id reaches over the start of a word, and words need no normalising.
        self.by_word = not self.charsmap and not self.trim and self.leading and not any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces) and not any(k == USER for _, _, k in self.pieces)


def backend(model: Model) -> Tokenizer:
    """A tokenizer with the ids of the model."""
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        # a piece that no text may become is out of every best path
        scores = [(p, s if k in (NORMAL, USER) else -1e4 if k == BYTE else s - 1e4) for p, s, k in model.pieces]
        tokenizer = Tokenizer(models.Unigram(scores, model.unknown, model.byte_fallback))
    else:
        usable = {p for p, _, k in model.pieces if k in (NORMAL, USER)}
        merges = []
        for piece, score, kind in model.pieces:
            if kind == NORMAL and len(piece) > 1:
                merges += [(-score, i, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
        merges.sort(key=lambda m: (m[0], ids[m[2] + m[3]], ids[m[2]], ids[m[3]]))
        tokenizer = Tokenizer(models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.leading:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    back: list = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.leading else []))
    return tokenizer


class Codec:
    """Encodes and decodes texts by the backend and compares it with ``sentencepiece``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.model = Model(data)
        self.tokenizer = backend(self.model)
        self.reference = SentencePieceProcessor(model_proto=data)
        self.starts = np.asarray([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.by_words = backend(self.model)
        self.by_words.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.odd_words: set[str] = set()
        self.last_space = np.asarray([i for i, p in enumerate(self.model.pieces) if p[0] == MARK][:1], "<i4").tobytes()
        self.controls = np.asarray([k in (CONTROL,) for _, _, k in self.model.pieces])
        self.words = Memory()

    def backend_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _checked(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        own, other = self.backend_ids(texts), self.reference.encode(texts, num_threads=1) if texts else []
        return [(np.asarray(b, "<i4").tobytes(), a == b) for a, b in zip(own, other, strict=True)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, many words in one text, which is cut at the markers; words that ``sentencepiece`` encodes otherwise are noted."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            joined = self.by_words.encode_batch_fast([" ".join(part[i : i + 1000]) for i in range(0, len(part), 1000)], add_special_tokens=False)
            found = cut_at(np.asarray([x for e in joined for x in e.ids], "<i4").tobytes(), self.starts, len(part))
            if found is None:
                found = [b for b, _ in self._checked(part)]
            for i, want in enumerate(self.reference.encode(part, num_threads=1)):
                want = array("i", want).tobytes()
                if want != found[i]:
                    self.odd_words.add(part[i])
                    found[i] = want
            out += found
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Of each text its ids as little-endian 32-bit bytes, and whether backend and reference agree."""
        split = [t.split(" ") if self.model.by_word and t and t[0] != " " and "  " not in t and MARK not in t else None for t in texts]
        met: set[str] = set()
        for words in split:
            if words:
                met.update(words)
        self.words.renew()
        new = [w for w in self.words.missing(met) if w]
        # the leading marker of each is that of its word; a lone marker is what follows a last space
        known = self.words.found
        known.update(zip(new, self._word_ids(new), strict=True))
        known[""] = self.last_space
        whole = iter(self._checked([t for t, words in zip(texts, split, strict=True) if words is None]))
        return [next(whole) if words is None else (b"".join(map(known.__getitem__, words)), not self.odd_words or self.odd_words.isdisjoint(words)) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; control pieces write nothing."""
        return self.tokenizer.decode_batch([x[~self.controls[x]].tolist() for x in ids], skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(ids: list[bytes | None]) -> pa.Array:
    lengths = np.asarray([len(x) // 4 if x else 0 for x in ids])
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.asarray([x is None for x in ids] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4")))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                found = iter(codec(path).encode([t for t in texts if t is not None]))
                rows = [None if t is None else next(found) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), _lists([r and r[0] for r in rows]), pa.array([r and r[1] for r in rows], pa.bool_())], ["id", "ids", "parity"])

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, parity of each row; ``model`` is the path of a SentencePiece model file."""
    rows = own_columns(docs, id=id_col, text=text_col)
    return rows.mapInArrow(_encode(model), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, parity boolean").withColumnRenamed("id", "doc_id")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids").cast(pa.list_(pa.int32()))
            lengths = np.asarray([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
            for a, b in slices(np.concatenate([[0], np.cumsum(lengths * 4)])):
                part = column.slice(a, b - a)
                lists = [x.values.to_numpy() for x in part if x.is_valid]
                found = iter(codec(path).decode(lists))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([next(found) if v else None for v in part.is_valid().to_pylist()], pa.string())], ["id", "text"])

    return run


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids."""
    rows = own_columns(rows, id=id_col, ids=ids_col)
    return rows.mapInArrow(_decode(model), f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", "doc_id")


def _both(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in _encode(path)(batches):
            lists = [np.frombuffer(x.values.to_numpy(), np.int32) if x.is_valid else None for x in batch.column("ids")]
            texts = iter(own.decode([x for x in lists if x is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(texts) for x in lists], pa.string())], ["id", "ids", "parity", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, parity and the text that the ids decode to, in one pass."""
    rows = own_columns(docs, id=id_col, text=text_col)
    return rows.mapInArrow(_both(model), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, parity boolean, decoded string").withColumnRenamed("id", "doc_id")
