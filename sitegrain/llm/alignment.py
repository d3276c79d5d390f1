"""Alignment of two tokenizations of the same texts: a byte-level BPE (A) and a SentencePiece model (B).

A text is encoded by both; the byte offsets where tokens of both end cut them into groups, and the last tokens of a group are a link. What a
byte range holds is a ``Fragment``: an open head (tokens up to the first common end), closed groups and an open tail (tokens after the last
common end). Fragments of neighbouring ranges compose: the tail of the one and the head of the next close a group. That is associative and the
empty fragment is its identity, so a text of any length is folded as a tree. Links need no composing, as both tokens of a link end in its range.

Texts of up to ``CHUNK`` bytes are aligned where they lie. Longer ones are cut into ranges at places where both tokenizers must cut, which are
dealt over tasks; a range without such a place is encoded whole and put out as fragments of ``CHUNK`` bytes each. Fragments of a
text are then composed in a tree of joins of ``FAN``, one level at a time. No step but the last holds a long text whole, and the last holds the groups of one.

Both tokenizers cut before a space, and B's pieces never hold a line feed, so between characters other than white space these are safe places
(``Aligner`` checks that of the model and encodes texts whole otherwise). The units between them recur: each is aligned once in a worker while
it is remembered, many new ones as one text.

How often a pair is linked corpus-wide is counted over all texts. Scores read these counts in slices of ``SLICE`` pairs, each sent to the
workers in a pass of its own, so that a worker holds a bounded part however many pairs there are.

Defined results: a null or empty text, and one whose joined tokens of A or B aren't the bytes of a space and the text (it holds U+2581, say),
has no tokens, no links and an empty ``groups_sha256``. Repeated rows count again; a null id is carried along. Special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sitegrain.llm.common import bytes_of, own_columns, slices
from sitegrain.session import cut_lineage, forget

#: Bytes of a range of a long text, and fragments that are composed at a time.
CHUNK, FAN = 65_536, 16
#: Pairs whose counts are sent to the workers at a time.
SLICE = 2_000_000
#: Units of a generation that a worker remembers (those of the last two are known), and units that are encoded as one text.
REMEMBERED, TOGETHER = 250_000, 5_000
#: Distinct pairs that a task adds up before it puts them out.
HELD = 1_000_000

MARK = "▁"
#: Safe places: before a space or line feed that stands between two characters other than white space.
SPACES, LINES = r"(?<=\S)(?= \S)", r"(?<=\S)(?=\n\S)"


def joined(a: str, b: str, by: str = ",") -> str:
    return f"{a}{by}{b}" if a and b else a or b


class Fragment(NamedTuple):
    """Tokens that end in a byte range, as decimal ids; without a common end (``cut``) all of them are the head."""

    cut: bool = False
    head_a: str = ""
    head_b: str = ""
    closed: str = ""
    tail_a: str = ""
    tail_b: str = ""

    def then(self, after: Fragment) -> Fragment:
        if not self.cut and not after.cut:
            return Fragment(False, joined(self.head_a, after.head_a), joined(self.head_b, after.head_b))
        if not self.cut:
            return after._replace(head_a=joined(self.head_a, after.head_a), head_b=joined(self.head_b, after.head_b))
        if not after.cut:
            return self._replace(tail_a=joined(self.tail_a, after.head_a), tail_b=joined(self.tail_b, after.head_b))
        met = f"{joined(self.tail_a, after.head_a)}|{joined(self.tail_b, after.head_b)}"
        return Fragment(True, self.head_a, self.head_b, joined(joined(self.closed, met, ";"), after.closed, ";"), after.tail_a, after.tail_b)

    def whole(self) -> str | None:
        """The groups of a complete text; None if its end isn't a common one."""
        return joined(f"{self.head_a}|{self.head_b}", self.closed, ";") if self.cut and not self.tail_a and not self.tail_b else None


def folded(fragments: list[Fragment]) -> Fragment:
    """The composition of a sequence, by halves."""
    while len(fragments) > 1:
        fragments = [fragments[i].then(fragments[i + 1]) if i + 1 < len(fragments) else fragments[i] for i in range(0, len(fragments), 2)]
    return fragments[0] if fragments else Fragment()


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Stretch(NamedTuple):
    """Both tokenizations of a stretch of bytes: ids, their ends, and the common ends."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    common: np.ndarray

    def links(self) -> np.ndarray:
        """Of each common end the ids that end there, A's in the upper 32 bits."""
        return self.a[np.searchsorted(self.a_end, self.common)] << 32 | self.b[np.searchsorted(self.b_end, self.common)]

    def fragment(self, low: int, high: int) -> Fragment:
        """Of the tokens that end after ``low`` and up to ``high``."""
        ends = self.common[np.searchsorted(self.common, low, "right") : np.searchsorted(self.common, high, "right")]
        parts = []
        for ids, end in ((self.a, self.a_end), (self.b, self.b_end)):
            first, last = np.searchsorted(end, [low, high], "right")
            names = list(map(str, ids[first:last].tolist()))
            cuts = (np.searchsorted(end, ends) + 1 - first).tolist()
            parts.append([",".join(names[i:j]) for i, j in zip([0, *cuts], [*cuts, len(names)], strict=True)])
        a, b = parts
        if not len(ends):
            return Fragment(False, a[0], b[0])
        return Fragment(True, a[0], b[0], ";".join(map("|".join, zip(a[1:-1], b[1:-1], strict=True))), a[-1], b[-1])


class Unit(NamedTuple):
    """A unit that ends at a common end: its groups, links (eight bytes each) and numbers of tokens; ``groups`` is None where the bytes differ."""

    groups: str | None
    links: bytes
    n_a: int
    n_b: int


class Aligner:
    """Aligns texts that begin with the space that A is given and B adds."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.asarray([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.mark = self.b.piece_to_id(MARK)
        by_space = not any(MARK in p.lstrip(MARK) for p in pieces)
        by_line = by_space and not any("\n" in p for p in pieces)
        self.place = re.compile(f"{SPACES}|{LINES}" if by_line else SPACES if by_space else r"(?!)")
        self.units: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}

    def stretch(self, text: str) -> Stretch | None:
        """``text`` begins with a space or a line feed; None where the bytes differ."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if text[:1] == " ":
            b = self.b.encode(text[1:])
        else:
            b = self.b.encode(text)
            if b[:1] != [self.mark]:
                return None
            b = b[1:]
        data = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        return Stretch(a, b, a_end, b_end, np.intersect1d(a_end, b_end, assume_unique=True))

    def unit(self, text: str) -> Unit:
        found = self.stretch(text)
        groups = found and found.fragment(0, len(text.encode())).whole()
        return Unit(groups, found.links().tobytes(), len(found.a), len(found.b)) if groups else Unit(None, b"", 0, 0)

    def learn(self, new: list[str]) -> None:
        """Aligns units that begin with white space, hold no other before their end and none of B's markers: many as one text."""
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            found = self.stretch(" x" + "".join(part))
            ends = 2 + np.cumsum([len(u.encode()) for u in part])
            if found is None or not np.isin(ends, found.common, assume_unique=True).all():
                for u in part:
                    self.units[u] = self.unit(u)
                continue
            links = found.links()
            last = np.searchsorted(found.common, ends) + 1
            first = np.r_[np.searchsorted(found.common, 2) + 1, last[:-1]]
            a_cut, b_cut = ((np.searchsorted(e, found.common) + 1).tolist() for e in (found.a_end, found.b_end))
            a_name, b_name = list(map(str, found.a.tolist())), list(map(str, found.b.tolist()))
            for u, i, j in zip(part, first.tolist(), last.tolist(), strict=True):
                groups = ";".join([f"{','.join(a_name[a_cut[k - 1] : a_cut[k]])}|{','.join(b_name[b_cut[k - 1] : b_cut[k]])}" for k in range(i, j)])
                self.units[u] = Unit(groups, links[i:j].tobytes(), a_cut[j - 1] - a_cut[i - 1], b_cut[j - 1] - b_cut[i - 1])

    def aligned(self, texts: list[str]) -> list[list[Unit]]:
        """The units of each text."""
        if len(self.units) > REMEMBERED:
            self.older, self.units = self.units, {}
        split = [self.place.split(t) for t in texts]
        new, odd = [], []
        for unit in set().union(*split).difference(self.units):
            if unit in self.older:
                self.units[unit] = self.older[unit]
            elif MARK in unit or unit[1:2].isspace() or unit[-1:].isspace() or len(unit) > 1000:
                odd.append(unit)
            else:
                new.append(unit)
        self.learn(new)
        for unit in odd:
            self.units[unit] = self.unit(unit)
        return [list(map(self.units.__getitem__, units)) for units in split]

    def ranges(self, text: str, chunk: int) -> Iterator[tuple[int, str]]:
        """Byte start and text of ranges of at most ``chunk`` bytes between safe places, or one unit."""
        start = at = begin = seen = 0
        for place in [*(m.start() for m in self.place.finditer(text)), len(text)]:
            upto = seen + len(text[at:place].encode())
            if upto - begin > chunk and at > start:
                yield begin, text[start:at]
                start, begin = at, seen
            at, seen = place, upto
        yield begin, text[start:]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of two tokenizer files."""
    key = a_path, b_path
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([_lists(list(c)) if k == "lists" else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


ROW = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, counts array<long>"
NAMES, KINDS = ["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), "lists", "lists"]
NONE = np.zeros(0, np.int64)
NOTHING = (0, 0, 0, "", NONE, NONE)


def _result(groups: str | None, n_a: int, n_b: int, pairs: np.ndarray, counts: np.ndarray) -> tuple:
    return NOTHING if groups is None else (n_a, n_b, int(counts.sum()), hashlib.sha256(groups.encode()).hexdigest(), pairs, counts)


def _short(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                found = iter(own.aligned([f" {t}" for t in texts if t]))
                rows = []
                for t in texts:
                    units = next(found) if t else []
                    groups = [u[0] for u in units]
                    if not units or None in groups:
                        rows.append(NOTHING)
                        continue
                    pairs, counts = np.unique(np.frombuffer(b"".join([u[1] for u in units]), np.int64), return_counts=True)
                    rows.append(_result(";".join(groups), sum([u[2] for u in units]), sum([u[3] for u in units]), pairs, counts))
                rest = _batch(rows, NAMES, KINDS)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *rest.columns], ["id", *NAMES])

    return run


def _ranges(a_path: str, b_path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for i in range(batch.num_rows):
                for at, text in own.ranges(f" {batch.column('text')[i].as_py()}", chunk):
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), pa.array([at], pa.int64()), pa.array([text], pa.string())], ["row", "at", "text"])

    return run


PART = "row long, at long, ok boolean, n_a long, n_b long, cut boolean, head_a string, head_b string, closed string, tail_a string, tail_b string, pairs array<long>, counts array<long>"
PART_NAMES = ["row", "at", "ok", "n_a", "n_b", *Fragment._fields, "pairs", "counts"]
PART_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 5, "lists", "lists"]


def _fragments(a_path: str, b_path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for row, at, text in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "text")), strict=True):
                found, size = own.stretch(text), len(text.encode())
                if found is None:
                    yield _batch([(row, at, False, 0, 0, *Fragment(), NONE, NONE)], PART_NAMES, PART_KINDS)
                    continue
                links = found.links()
                for low in range(0, size, chunk):
                    high = min(size, low + chunk)
                    i, j = np.searchsorted(found.common, [low, high], "right")
                    n_a, n_b = (int(np.diff(np.searchsorted(e, [low, high], "right"))[0]) for e in (found.a_end, found.b_end))
                    yield _batch([(row, at + low, True, n_a, n_b, *found.fragment(low, high), *np.unique(links[i:j], return_counts=True))], PART_NAMES, PART_KINDS)

    return run


def _composed(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """One row of the fragments of neighbouring ranges."""
    rows = parts.sort_by("at").to_pylist()
    ok = all(r["ok"] for r in rows)
    fragment = folded([Fragment(*(r[c] for c in Fragment._fields)) for r in rows]) if ok else Fragment()
    pairs, at = np.unique(np.concatenate([np.asarray(r["pairs"], np.int64) for r in rows]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([np.asarray(r["counts"], np.int64) for r in rows]), len(pairs)).astype(np.int64)
    row = (rows[0]["row"], rows[0]["at"], ok, sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), *fragment, pairs, counts)
    return pa.Table.from_batches([_batch([row], PART_NAMES, PART_KINDS)])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            groups = Fragment(*(r[c] for c in Fragment._fields)).whole() if r["ok"] else None
            rows.append((r["row"], *_result(groups, r["n_a"], r["n_b"], np.asarray(r["pairs"], np.int64), np.asarray(r["counts"], np.int64))))
        yield _batch(rows, ["row", *NAMES], [pa.int64(), *KINDS])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 of each row, and its linked pairs (A's id in the upper 32 bits) with their counts."""
    rows = own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) >= chunk
    short = rows.where(~is_long).mapInArrow(_short(a_path, b_path), f"id {kind}, {ROW}")
    named = cut_lineage(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()))
    ranges = named.select("row", "text").mapInArrow(_ranges(a_path, b_path, chunk), "row long, at long, text string")
    parts = cut_lineage(ranges.repartition("row", "at").mapInArrow(_fragments(a_path, b_path, chunk), PART))
    width, furthest = chunk, parts.agg(F.max("at")).first()[0]
    tree = parts
    while furthest is not None:
        width *= fan
        tree = tree.groupBy("row", F.expr(f"at DIV {width}")).applyInArrow(_composed, PART)
        if furthest < width:
            break
    whole = named.select("row", "id").join(tree.mapInArrow(_finished, f"row long, {ROW}"), "row").select("id", *NAMES)
    return short.union(whole).withColumnRenamed("id", "doc_id")


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, counts, size = [], [], 0
    put_out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _added(pairs, counts)], ["pair", "n"])
    for batch in batches:
        pairs.append(batch.column("pairs").flatten().to_numpy())
        counts.append(batch.column("counts").flatten().to_numpy())
        size += len(pairs[-1])
        if size > 4 * HELD:
            keys, n = _added(pairs, counts)
            pairs, counts, size = [keys], [n], len(keys)
            if size > HELD:
                yield put_out()
                pairs, counts, size = [], [], 0
    if size:
        yield put_out()


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold each pair, and whether no other pair of its B id has more."""
    counted = cut_lineage(aligned.select("pairs", "counts").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    own = counted.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = own.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return own.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_sent: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _scored(sent, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _sent:  # a worker keeps one slice
            _sent.clear()
            _sent[name] = sent.value
        keys, n, best = _sent[name]
        for batch in batches:
            pairs, counts = (batch.column(c).flatten().to_numpy() for c in ("pairs", "counts"))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            counts = np.where(keys[at] == pairs, counts, 0) if len(keys) else np.zeros(len(pairs), np.int64)
            edges = np.concatenate([[0], np.cumsum(batch.column("pairs").value_lengths().to_numpy())])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])  # noqa: E731, B023
            found = (total(counts * best[at]), total(counts * n[at])) if len(keys) else (np.zeros(batch.num_rows, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, found)], ["row", "n_best", "count_sum"])

    return run


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``aligned``, a written table with a column ``row`` that numbers them, with n_best and count_sum."""
    context = aligned.sparkSession.sparkContext
    parts = max(1, -(-counts.count() // SLICE))
    sums = []
    for part in range(parts):
        local = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).toArrow()  # about SLICE rows
        order = np.argsort(local.column("pair").to_numpy())
        sent = context.broadcast(tuple(local.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
        scored = aligned.select("row", "pairs", "counts").mapInArrow(_scored(sent, uuid.uuid4().hex), "row long, n_best long, count_sum long")
        sums.append(cut_lineage(scored))
        sent.unpersist()
    together = sums[0]
    for more in sums[1:]:
        together = together.union(more)
    return aligned.join(together.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "row")


def aligned_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the commonest of its B id), count_sum (of their pairs' counts) and groups_sha256 of each row."""
    aligned = cut_lineage(align(docs, a_path, b_path, id_col, text_col, chunk, fan).withColumn("row", F.monotonically_increasing_id()))
    counts = cut_lineage(link_counts(aligned))
    scored = score_links(aligned, counts)
    forget(counts)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
