"""Quality rules: repetition counts of a text, and how far its letters and common words diverge from those of languages.

A language's references are two histograms over all of its documents: of ``CLASSES`` of characters, and of its ``COMMON`` most frequent words
(A-Z lowered) with everything else as one more bin. A document is as far from a language as the Jensen-Shannon distance (the root of
the divergence in bits, 0 to 1) of its own histogram, and what counts is the nearest language, so a wrong or missing label does no harm.
Short texts aren't judged: distances count from ``MIN_CHARS`` code points and ``MIN_WORDS`` words on.

Texts are read twice: words are counted per language by Spark, and a second pass makes a narrow row of each document, from which the
character references are added up and the verdicts made. The references are small: those of at most ``LANGUAGES`` languages, the largest of
those with ``MIN_REFERENCE`` words; a document in another language is compared with these as well.

Defined results: a null or empty text has no words and fails the base rules; a null language makes no reference; without any reference
only the base rules decide; of equally frequent words the first in code-point order is common; repeated rows count again.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.llm.common import bytes_of, own_columns, slices
from sitegrain.session import cut_lineage

COMMON, LANGUAGES, MIN_REFERENCE = 50, 100, 1000
MIN_CHARS, MIN_WORDS = 200, 100
#: Greatest distances of characters and of words that are kept.
FAR_CHARS, FAR_WORDS = 0.25, 0.36

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"
#: Classes of characters; what is in none of them is the last class.
CLASSES = [LOWER, UPPER, "0123456789", ".,;:?!'\"()-", " \t\n\v\f\r", "".join(map(chr, range(0xC0, 0x250))), "".join(map(chr, [*range(9), *range(14, 32), 127])) + "#$%&*+/<=>@[\\]^_`{|}~"]
#: The class of each character below U+0250, and of those beyond.
CLASS_OF = np.full(0x251, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES):
    CLASS_OF[[ord(c) for c in _members]] = _i
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def distances(own: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of each row of ``own`` from ``reference``; both are shares."""
    middle = (own + reference) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(middle > 0, middle, 1)), 0)
    return np.sqrt(np.maximum(0, (part(own) + part(np.broadcast_to(reference, own.shape))).sum(1) / 2))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    numbers: defaultdict[bytes, int] = defaultdict(lambda: len(numbers))
    w = np.fromiter((numbers[x] for x in words), np.int64, len(words))
    _, two = np.unique(w[:-2] * len(numbers) + w[1:-1], return_inverse=True)
    _, three, times = np.unique(two * len(numbers) + w[2:], return_inverse=True, return_counts=True)
    inside = np.zeros(len(w), bool)
    for i in range(3):
        inside[i : len(w) - 2 + i] |= times[three] > 1
    return int(inside.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal one before."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


Reference = dict[str, dict[bytes, float]]


def _measured(references: Reference):
    names = [[*r] for r in references.values()]
    shares = [np.asarray([*r.values(), 1 - sum(r.values())]) for r in references.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = bytes_of(batch.column("text"))
            for a, b in slices(offsets):
                rows, counted = [], []
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    data = (text or "").encode()
                    words = data.split()
                    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
                    classes = np.bincount(CLASS_OF[np.minimum(points, 0x250)], minlength=len(CLASSES) + 1)
                    symbols = sum(map(data.count, map(str.encode, SYMBOLS)))
                    rows.append((len(words), len(points) - int(classes[4]), symbols, repeated_lines(data), repeated_words(words), classes.tolist(), len(points)))
                    counted.append((Counter(data.translate(FOLD).split()), len(words)))
                far = np.full((b - a, max(len(names), 1)), np.inf)
                size = np.asarray([n for _, n in counted], np.float64)
                full = size > 0
                for i, (common, share) in enumerate(zip(names, shares, strict=True)):
                    own = np.asarray([[c[w] for w in common] for (c, _) in counted], np.float64) / np.maximum(size, 1)[:, None]
                    far[full, i] = distances(np.column_stack([own, 1 - own.sum(1)])[full], share)
                nearest = far.min(1)
                columns = [*zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("lang").slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.int64()), pa.array(nearest, mask=~np.isfinite(nearest))],
                    ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "n_chars", "word_far"],
                )

    return run


def _judged(references: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column("classes").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            size = counts.sum(1)
            far = np.full((len(counts), max(len(references), 1)), np.inf)
            for i, reference in enumerate(references):
                far[size > 0, i] = distances((counts / np.maximum(size, 1)[:, None])[size > 0], reference)
            nearest = far.min(1)
            keep = [n for n in batch.schema.names if n not in ("lang", "classes")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(nearest, mask=~np.isfinite(nearest))], [*keep, "char_far"])

    return run


def word_references(docs: DataFrame, common: int = COMMON) -> Reference:
    """Of each language its most frequent words with their shares; ``docs`` has the columns lang and text."""
    # the pattern has no group, so group 0 is a word
    words = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    counts = cut_lineage(docs.where("lang IS NOT NULL").select("lang", words.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_REFERENCE)
    largest = totals.orderBy(F.desc("total"), "lang").limit(LANGUAGES)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= common).join(F.broadcast(largest), "lang")  # LANGUAGES rows
    found: Reference = {}
    for r in top.orderBy("lang", "place").collect():  # LANGUAGES * common rows at most
        found.setdefault(r["lang"], {})[r["word"].encode()] = r["n"] / r["total"]
    return found


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, word_far, char_far, base_failed, kept of each row."""
    rows = own_columns(docs, id=id_col, text=text_col, lang=lang_col)
    rows = rows.withColumn("lang", F.col("lang").cast("string"))
    references = word_references(rows)
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    kind = rows.schema["id"].dataType.simpleString()
    measured = cut_lineage(rows.mapInArrow(_measured(references), f"doc_id {kind}, lang string, {fields}, classes array<long>, n_chars long, word_far double"))
    sums = measured.where(F.col("lang").isin(*references)).groupBy("lang").agg(F.array(*[F.sum(F.col("classes")[i]) for i in range(len(CLASSES) + 1)]).alias("c"))
    shares = [np.asarray(r["c"], np.float64) / sum(r["c"]) for r in sums.orderBy("lang").collect()] if references else []
    judged = measured.mapInArrow(_judged(shares), f"doc_id {kind}, {fields}, n_chars long, word_far double, char_far double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    diverges = lambda size, least, far, limit: (F.col(size) >= least) & (F.coalesce(far, F.lit(0.0)) > limit)
    strange = diverges("n_chars", MIN_CHARS, "char_far", FAR_CHARS) | diverges("n_words", MIN_WORDS, "word_far", FAR_WORDS)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~strange)
