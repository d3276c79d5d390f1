"""Text measures as Column expressions: tokens, readability, hashes, result-page widths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopword list that decides n-gram edges, candidates and clusters.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has "
    "hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in "
    "into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours "
    "ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them "
    "themselves then there there's these they they'd they'll they're they've this those through to too under until up very was "
    "wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's will "
    "with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves also just get got may might must "
    "one us like new use used using via within without per yet"
).split()

# Arial advance widths per 1000 units; a later line overrides an earlier one.
ARIAL_WIDTHS = [
    (" !,./:;I[\\]fijlt'|", 278),
    ("ijl", 222),
    ('"', 355),
    ("#$0123456789?L_abdeghnopqu", 556),
    ("%", 889),
    ("&ABEKPSVXY", 667),
    ("()-`r", 333),
    ("*", 389),
    ("+<=>~", 584),
    ("@", 1015),
    ("CDHNRUw", 722),
    ("FTZ", 611),
    ("GOQ", 778),
    ("J", 500),
    ("M", 833),
    ("W", 944),
    ("^", 469),
    ("ckvsxyz", 500),
    ("m", 833),
    ("{}", 334),
]
DEFAULT_WIDTH, WIDE_WIDTH, WIDE_FROM = 556, 1000, 0x2E80
TITLE_PX, TITLE_LIMIT_PX = 20, 600
SNIPPET_PX, SNIPPET_LIMIT_PX = 14, 920

WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"
# A sentence end: text, end marks, then space or the end. Anchored to the last match or end mark, so it never rescans.
SENTENCE_TEMPLATE = r"(?:\G|(?<=[.!?]))[^.!?]++[.!?]++(?:%s|\z)"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SENTENCE = SENTENCE_TEMPLATE % SPACE


def js_round(value: Column) -> Column:
    """Halves go up, as in the numbers this library has to match."""
    return F.floor(value + F.lit(0.5))


def squeeze(text: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.regexp_replace(F.regexp_replace(text, SPACE + "+", " "), "^ | $", "")


def tokenize(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    trimmed = F.transform(words, lambda w: F.regexp_replace(F.translate(w, "’", "'"), r"^['\-]+|['\-]+$", ""))
    return F.filter(trimmed, lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def count_syllables(word: Column) -> Column:
    def count(letters: Column) -> Column:
        core = F.regexp_replace(F.regexp_replace(letters, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
        groups = F.regexp_count(core, F.lit("[aeiouy]{1,2}"))
        return F.when(letters == "", 0).when(F.length(letters) <= 3, 1).otherwise(F.greatest(F.lit(1), groups))

    return let(F.regexp_replace(F.lower(word), "[^a-z]", ""), count)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total_syllables(words: Column) -> Column:
    """Sum of ``count_syllables`` over an array of Latin words, by a few passes over the joined text instead of one per word."""
    joined = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z ]", "")

    def count(text: Column) -> Column:
        long_ = F.regexp_replace(text, "(?<![a-z])[a-z]{1,3}(?![a-z])", "")
        return F.regexp_replace(F.regexp_replace(long_, "(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?![a-z])", ""), "(?<![a-z])y", "")

    def add(core: Column) -> Column:
        groups = F.regexp_count(core, F.lit("[aeiouy]{1,2}"))
        voiced = F.regexp_count(core, F.lit("[b-df-hj-np-tv-xz]*+[aeiouy][a-z]*"))
        return F.size(words) + groups - voiced

    return let(let(joined, count), add)


def readability(text: Column) -> Column:
    """struct<sentences, words, words_per_sentence, flesch, label>; null below 30 words."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'’-]*"), F.lit(0))
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit(SENTENCE)))

    def measure(w: Column) -> Column:
        return F.struct(F.size(w).alias("words"), sentences.alias("sentences"), total_syllables(w).alias("syllables"))

    def rate(m: Column) -> Column:
        per_sentence = m["words"].cast("double") / m["sentences"]
        raw = F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * (m["syllables"].cast("double") / m["words"])
        return F.struct(
            m["sentences"].alias("sentences"),
            m["words"].alias("words"),
            (js_round(per_sentence * 10) / 10).alias("words_per_sentence"),
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("score"),
        )

    def label(r: Column) -> Column:
        score = r["score"]
        band = (
            F.when(score >= 80, "Very easy")
            .when(score >= 70, "Easy")
            .when(score >= 60, "Plain English")
            .when(score >= 50, "Fairly difficult")
            .when(score >= 30, "Difficult")
            .otherwise("Very difficult")
        )
        return F.struct(
            r["sentences"].alias("sentences"), r["words"].alias("words"), r["words_per_sentence"].alias("words_per_sentence"),
            js_round(score).cast("int").alias("flesch"), band.alias("label"),
        )

    return let(words, lambda w: F.when(F.size(w) >= 30, let(let(measure(w), rate), label)))


def ngrams(tokens: Column, n: int) -> Column:
    """Phrases of n tokens that neither start nor end in a stopword and hold no one-letter token."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    windows = F.transform(starts, lambda i: F.slice(tokens, i, n))
    kept = F.filter(
        windows,
        lambda g: ~F.element_at(g, 1).isin(STOPWORDS)
        & ~F.element_at(g, n).isin(STOPWORDS)
        & ~F.exists(g, lambda t: F.length(t) < 2),
    )
    return F.transform(kept, lambda g: F.array_join(g, " "))


def repetitions(phrases: Column) -> Column:
    """array<struct<less, phrase>> of the phrases that an array holds at least twice; ``less`` is their count below zero, so the most frequent sorts first."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda p, i: F.when(~F.get(s, i + 1).eqNullSafe(p), i + 1)), lambda e: e.isNotNull())
        counted = let(ends, lambda e: F.transform(e, lambda end, j: F.struct((F.when(j == 0, 0).otherwise(F.get(e, j - 1)) - end).alias("less"), F.get(s, end - 1).alias("phrase"))))
        return F.filter(counted, lambda r: r["less"] <= -2)

    return let(F.array_sort(phrases), runs)


def phrase_occurrences(tokens: Column, phrase: Column) -> Column:
    """How often the token array ``phrase`` appears in a row inside ``tokens``."""
    n = F.size(phrase)
    starts = F.when(
        (n > 0) & (F.size(tokens) >= n), F.sequence(F.lit(1), F.size(tokens) - n + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, n) == phrase))


def content_hash(text: Column) -> Column:
    """32-bit FNV-1a of the lower-cased, space-collapsed text over its UTF-16 units, 8 hex digits."""

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    def fold(h: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("bigint")
        high = F.lit(0xD7C0) + F.shiftright(code, 10)
        low = F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF))
        return F.when(ch == "", h).when(code < 65536, step(h, code)).otherwise(step(step(h, high), low))

    chars = F.split(squeeze(F.lower(text)), "")
    return F.lower(F.lpad(F.hex(F.aggregate(chars, F.lit(2166136261).cast("bigint"), fold)), 8, "0"))


def _width_of() -> dict[str, int]:
    table: dict[str, int] = {}
    for chars, width in ARIAL_WIDTHS:
        table.update(dict.fromkeys(chars, width))
    return table


def pixel_width(text: Column, font_px: int) -> Column:
    """Rendered width: characters are counted per width class, so no per-character lookup is needed.

    One pass turns each character of a class into the first of its class; a class is then counted by that character alone.
    """
    classes: dict[int, str] = {}
    for ch, width in _width_of().items():
        if width != DEFAULT_WIDTH:
            classes[width] = classes.get(width, "") + ch
    marked = F.translate(text, "".join(classes.values()), "".join(chars[0] * len(chars) for chars in classes.values()))
    units = F.length(text) * F.lit(DEFAULT_WIDTH)
    for width, chars in classes.items():
        count = F.length(text) - F.length(F.replace(marked, F.lit(chars[0]), F.lit("")))
        units = units + count * F.lit(width - DEFAULT_WIDTH)
    wide = F.regexp_count(text, F.lit(rf"[\x{{{WIDE_FROM + 1:X}}}-\x{{10FFFF}}]"))
    units = units + wide * F.lit(WIDE_WIDTH - DEFAULT_WIDTH)
    return js_round(units / F.lit(1000) * F.lit(font_px)).cast("int")


def truncate_to_pixels(text: Column, font_px: int, max_px: int) -> Column:
    """struct<text, truncated>: the longest prefix that fits with an ellipsis, cut back to a word edge."""
    known = _width_of()
    ascii_widths = F.array(*[F.lit(known.get(chr(i), DEFAULT_WIDTH)) for i in range(128)])
    room = max_px - int(4 * 278 / 1000 * font_px + 0.5)

    def units(ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 128, F.get(ascii_widths, code)).when(code > WIDE_FROM, WIDE_WIDTH).otherwise(DEFAULT_WIDTH)

    def walk(state: Column, ch: Column) -> Column:
        total = state["units"] + units(ch)
        fits = state["open"] & (js_round(total / F.lit(1000) * F.lit(font_px)) <= room)
        return F.struct(
            total.alias("units"), (state["n"] + fits.cast("int")).alias("n"), fits.alias("open")
        )

    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    kept = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, walk)["n"]
    prefix = F.substring(text, F.lit(1), kept)
    last_space = F.length(prefix) - F.locate(" ", F.reverse(prefix))
    cut = F.when((F.locate(" ", prefix) > 0) & (last_space > F.length(prefix) * 0.6), F.substring(prefix, F.lit(1), last_space))
    short = F.concat(F.regexp_replace(F.coalesce(cut, prefix), SPACE + r"+\z", ""), F.lit(" ..."))
    too_wide = pixel_width(text, font_px) > max_px
    return F.struct(F.when(too_wide, short).otherwise(text).alias("text"), too_wide.alias("truncated"))


def slug(text: Column) -> Column:
    base = F.regexp_replace(F.lower(text), "^https?://", "")
    dashed = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-|-$", "")
    cut = F.substring(dashed, 1, 60)
    return F.when(cut == "", "export").otherwise(cut)
