"""Personal data in texts: rules for its plain forms and a trained tagger for others.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers. The tagger, a character-level BiLSTM with a CRF, is trained on
windows around digits and at signs whose spans the rules have labelled, together with copies in which phone and card numbers
are written in ways that the rules don't know. In a text, every stretch around a digit or an at sign is covered by overlapping
windows (no kind exists without one of those characters). Each window is decoded; a span that touches the inner edge of its window is left to
the neighbour that sees it whole; among all spans of a text the set of disjoint ones with the highest total score is taken. Spans
of the tagger are added where they overlap no span of a rule, have the digits that their kind needs and stand free of word characters.

Bounded: ``TRAINING`` windows (smallest hashes). Whole texts are read, without a limit to their length or their number of spans.

Defined results: a null text is empty and has no spans; without anything to learn from, the rules work alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import bytes_of, own_columns, slices
from sitegrain.llm.tagger import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
#: Windows to train on at most, steps of training, characters of a window, and how far windows are apart.
TRAINING, STEPS, WIDTH, STRIDE = 1500, 120, 96, 48
#: Characters around a digit or an at sign that are looked at with it.
AROUND = 32

Span = tuple[int, int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT, _TRIGGER = re.compile("[0-9]"), re.compile("[0-9@]")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of each chain of numbers with single dots, four at a time: what a leftmost greedy search for four finds."""
    for chain in _NUMBERS.finditer(text):
        parts, start = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield start, end
            start = end + 1


def rule_spans(text: str) -> list[Span]:
    """(kind, start, end) of all that the rules find, by kind and start."""
    out = [(0, *s) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *s) for s in _addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Disjoint parts of a text that hold every digit and at sign with what stands around."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - AROUND <= out[-1][1]:
            out[-1][1] = min(len(text), m.end() + AROUND)
        else:
            out.append([max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)])
    return [(a, b) for a, b in out]


def windows_of(start: int, end: int) -> list[int]:
    """Where windows over a stretch begin."""
    return [*range(start, max(start + 1, end - WIDTH + STRIDE), STRIDE)]


def _tags(spans: list[Span], start: int) -> np.ndarray:
    """First and further characters of each kind; 0 elsewhere."""
    tags = np.zeros(WIDTH, np.int64)
    for kind, a, b in spans:
        a, b = max(a - start, -1), min(b - start, WIDTH)
        if b > 0 and a < WIDTH:
            tags[max(a, 0) : b] = 2 * kind + 2
            if a >= 0:
                tags[a] = 2 * kind + 1
    return tags


def rewritten(text: str, spans: list[Span]) -> tuple[str, list[Span]] | None:
    """The text with its phone and card numbers written in another way, and the spans there."""
    out, moved, at = "", [], 0
    if not any(kind in (2, 3) for kind, _, _ in spans):
        return None
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            return None
        out += text[at:a]
        own = text[a:b]
        if kind == 3:
            own = re.sub(r"^\+[0-9]+[ .-]*(?=\()", "", own) if "(" in own else own[1:]
        elif kind == 2:
            digits = re.sub("[^0-9]", "", own)
            own = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        moved.append((kind, len(out), len(out) + len(own)))
        out, at = out + own, b
    return out + text[at:], moved


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = rule_spans(text)
            for a, b in stretches(text):
                for start in windows_of(a, b):
                    inside = [s for s in spans if s[1] < start + WIDTH and s[2] > start]
                    part = text[start : start + WIDTH]
                    rows.append((part, _tags(inside, start).tolist()))
                    own = [(k, x - start, y - start) for k, x, y in inside if x >= start and y <= start + WIDTH]
                    other = rewritten(part, own) if len(own) == len(inside) else None
                    if other:
                        rows.append((other[0], _tags(other[1], 0).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["text", "tags"])


def fit(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    """A tagger trained on a bounded sample of labelled windows; none if no text has a digit or an at sign."""
    found = own_columns(docs, text=text_col).where(F.col("text").rlike("[0-9@]")).mapInArrow(_examples, "text string, tags array<long>")
    chosen = found.distinct().orderBy(F.xxhash64("text"), "text", "tags").limit(TRAINING).collect()
    if not chosen:
        return None
    return Tagger(2 * len(KINDS) + 1).fit(np.stack([classes(r.text, WIDTH) for r in chosen]), np.asarray([r.tags for r in chosen]), STEPS)


def reconcile(spans: list[tuple[float, int, int, int]]) -> list[Span]:
    """Of (score, kind, start, end), the disjoint ones with the highest total."""
    order = sorted(set(spans), key=lambda s: (s[3], s[2], s[1], s[0]))
    ends = [s[3] for s in order]
    best, take = [0.0] * (len(order) + 1), [False] * len(order)
    for i, (score, _, start, _) in enumerate(order):
        with_it = score + best[int(np.searchsorted(ends[:i], start, "right"))]
        take[i] = with_it > best[i]
        best[i + 1] = max(best[i], with_it)
    out, i = [], len(order)
    while i:
        if take[i - 1]:
            _, kind, start, end = order[i - 1]
            out.append((kind, start, end))
            i = int(np.searchsorted(ends[: i - 1], start, "right"))
        else:
            i -= 1
    return out[::-1]


def _plausible(text: str, kind: int, start: int, end: int) -> bool:
    own = text[start:end]
    digits = re.sub("[^0-9]", "", own)
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    if kind == 0:
        return own.count("@") == 1 and "." in own.partition("@")[2].strip(".") and not re.search(r"\s", own) and own[0] != "@"
    if kind == 1:
        return own.count(".") == 3 and len(digits) + 3 == len(own) and all(p and int(p) <= 255 for p in own.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and _luhn(digits) and not re.search("[^0-9 ./-]", own)
    return 9 <= len(digits) <= 15 and re.search("[^0-9]", own.strip("()")) is not None and not re.search(r"[^0-9+() ./-]", own) and own[0] in "+(0123456789"


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """The tagger's own spans in each text, reconciled over overlapping windows."""
    places = [(i, start, a, b) for i, text in enumerate(texts) for a, b in stretches(text) for start in windows_of(a, b)]
    seen: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    for at in range(0, len(places), 256):
        part = places[at : at + 256]
        tags, margin = tagger.decode(np.stack([classes(texts[i][s : s + WIDTH], WIDTH) for i, s, _, _ in part]))
        for (i, base, a, b), row, above in zip(part, tags, margin, strict=True):
            limit = min(WIDTH, len(texts[i]) - base)
            kind = np.where(row[:limit] > 0, (row[:limit] - 1) // 2, -1)
            cuts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (row[1:limit] % 2 == 1) & (row[1:limit] > 0)]) if limit else []
            for s, e in zip(cuts, [*cuts[1:], limit], strict=True) if limit else ():
                if kind[s] >= 0 and (s > 0 or base == a) and (e < limit or base + limit >= b):
                    seen[i].append((float(above[s:e].sum()), int(kind[s]), base + int(s), base + int(e)))
    return [reconcile(x) for x in seen]


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the spans of the rules, and those with the tagger's added, by kind and start."""
    out = [(base := rule_spans(t), base) for t in texts]
    look = [i for i, t in enumerate(texts) if _TRIGGER.search(t)] if tagger else []
    for i, found in zip(look, tagged_spans(tagger, [texts[i] for i in look]) if look else [], strict=True):
        base = out[i][0]
        new = [s for s in found if all(s[2] <= b or s[1] >= c for _, b, c in base) and _plausible(texts[i], *s)]
        out[i] = base, sorted(base + new)
    return out


def _find(tagger: Tagger | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.bool_())]))
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets):
                rows = []
                for base, every in all_spans(tagger, [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]):
                    own = set(base)
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "rule": (k, s, e) in own} for k, s, e in every])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(rows, kind)], ["id", "spans"])

    return run


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive, whether a rule found it) of each row."""
    rows = own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_find(tagger), f"id {kind}, spans array<struct<kind:string,start:long,end:long,rule:boolean>>").withColumnRenamed("id", "doc_id")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its (first) kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(tagger: Tagger | None, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            _, offsets = bytes_of(batch.column(at))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                found = all_spans(tagger, [t or "" for t in texts])
                clean = [t if t is None or not every else masked(t, every) for t, (_, every) in zip(texts, found, strict=True)]
                yield part.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return run


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text replaced by its kind in brackets."""
    return docs.mapInArrow(_redact(tagger, text_col), docs.schema)
