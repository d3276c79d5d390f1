"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

Training on a sequence costs a linear part for each token and a quadratic part for the attention within each document's piece.
A task takes its documents in windows of a bounded number of tokens. Whole sequences' worth of a document make sequences of their
own; what remains of it is dealt, longest first, to the sequence of the lowest estimated cost so far that still has room. A piece
that fits none of the cheapest sequences is cut, and its rest goes back among the waiting pieces. The sequences of a window have
room for exactly its tokens: all but the last few hold ``length`` tokens, and those are powers of two, which need no padding.

Nothing is shuffled and no group is gathered: a task packs the rows of its own partition. It gives the same sequences when it
is run again on the same rows, so pack a scan or a written table.

Defined results: a null text is empty; an empty text is the separator id alone; a null id is carried along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sitegrain.llm.bpe import encoder
from sitegrain.llm.common import bytes_of, own_columns, slices

#: Tokens that a task packs at a time; their ids are all it holds.
WINDOW = 4_000_000
#: Cheapest sequences that are asked for room before a piece is cut.
LOOK = 8
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def piece_cost(tokens: int, hidden: int) -> float:
    """Relative cost of a piece: 1 for each token, and for each pair of its tokens what attention adds in a model ``hidden`` wide."""
    return tokens + tokens * tokens / (6 * hidden)


def room_for(tokens: int, length: int) -> list[int]:
    """Sizes of sequences that hold exactly so many tokens: ``length`` as often as it fits, then powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(length.bit_length(), -1, -1) if rest >> k & 1]


def balance(sizes: list[int], length: int, hidden: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, tokens) that together hold every token of documents of these sizes once."""
    room = room_for(sum(sizes), length)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in room]
    cheapest = [(0.0, i) for i in range(len(room))]
    waiting = [(-n, doc, 0) for doc, n in enumerate(sizes) if n]
    heapq.heapify(waiting)
    while waiting:
        size, doc, start = heapq.heappop(waiting)
        size, passed = -size, []
        while len(passed) < LOOK and cheapest and room[cheapest[0][1]] < size:
            passed.append(heapq.heappop(cheapest))
        cost, i = heapq.heappop(cheapest) if cheapest and room[cheapest[0][1]] >= size else passed.pop(0)
        for entry in passed:
            heapq.heappush(cheapest, entry)
        taken = min(size, room[i])
        sequences[i].append((doc, start, taken))
        room[i] -= taken
        if room[i]:
            heapq.heappush(cheapest, (cost + piece_cost(taken, hidden), i))
        if taken < size:
            heapq.heappush(waiting, (taken - size, doc, start + taken))
    return sequences


def _pack(tokenizer: str, length: int, separator: int, hidden: int):
    end = np.asarray([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        next_id = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal next_id
            rows: list[tuple] = []

            def lay(pieces) -> None:
                nonlocal next_id
                offset = 0
                for doc, start, n in pieces:
                    name, ids = held[doc]
                    rows.append((name, start, n, len(ids) // 4, next_id, offset, ids[4 * start : 4 * (start + n)]))
                    offset += n
                next_id += 1

            whole = [len(ids) // 4 // length * length for _, ids in held]
            for doc, stop in enumerate(whole):
                for start in range(0, stop, length):
                    lay([(doc, start, length)])
            for pieces in balance([len(ids) // 4 - w for (_, ids), w in zip(held, whole, strict=True)], length, hidden):
                lay([(doc, whole[doc] + start, n) for doc, start, n in pieces])
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets, 4_000_000):
                names, texts = batch.column("id").slice(a, b - a).to_pylist(), batch.column("text").slice(a, b - a).to_pylist()
                for name, ids in zip(names, encode([t or "" for t in texts]), strict=True):
                    held.append((name, ids + end))
                    tokens += len(ids) // 4 + 1
                if tokens >= WINDOW:
                    yield packed()
                    held.clear()
                    tokens = 0
        if held:
            yield packed()

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, separator: int = 0, hidden: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).

    A document's ids are those of its whole text and then ``separator``; ``tokenizer`` is the path of a tokenizers file.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = own_columns(docs, id=id_col, text=text_col)
    return docs.selectExpr("CAST(id AS BIGINT) AS id", "text").mapInArrow(_pack(tokenizer, length, separator, hidden), SCHEMA)
