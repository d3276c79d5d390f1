"""Quality rules against a plain count, and the verdict of the distances on texts of two made languages."""

import math
import random

import numpy as np

from sitegrain.llm import quality

SCHEMA = "doc_id long, text string, lang string, n_words string, kept string"


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) by loops."""
    text = text or ""
    spaces = " \t\n\v\f\r"
    words, word = [], ""
    for c in text + " ":
        if c in spaces:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in spaces for c in line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def prose(rng, words, n):
    return " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n)).capitalize() + "."


def rows():
    rng = random.Random(4)
    one = ["the", "of", "and", "to"] + ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(400)]
    two = ["été", "où", "çà", "là"] + ["".join(rng.choices("éèàôpqrstu", k=rng.randrange(3, 9))) for _ in range(400)]
    good = [(i, "\n".join(prose(rng, w, rng.randrange(30, 60)) for _ in range(5)), lang) for i, (w, lang) in enumerate([(one, "en"), (two, "fr")] * 30)]
    good += [(90, good[1][1], "en"), (91, good[1][1], None), (91, good[1][1], None), (None, good[0][1], "xx")]
    junk = [(200, " ".join(f"{rng.choice(one)}{rng.choice(['###', '$$$', '&&&'])}" for _ in range(200)), "en"), (201, "".join(good[0][1]).upper().replace(" ", "!! "), "en")]
    junk += [(202, " | ".join("".join(rng.choices("xyzjkw", k=6)) for _ in range(200)), "en"), (203, good[0][1] + ("\n" + good[0][1]) * 3, "en"), (204, None, "en"), (205, "", None), (206, " \n\t ", "fr"), (207, "the of and", "en")]
    return good, junk


def test_base_columns_and_verdicts(spark):
    good, junk = rows()
    every = good + junk + [(300, "a b c a b c a b c d\nx\n\nx \nx\n|<>", "en"), (301, "un\x1cit é b \x85", "fr"), (302, "tell me tell me tell", "fr")]
    got = quality.judge(spark.createDataFrame([(*r, "x", "y") for r in every], SCHEMA).repartition(3)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], *(r[f] for f in fields)) for r in got), key=key) == sorted(((d, *base(t)) for d, t, _ in every), key=key)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[d] for d, _, _ in good) and not any(kept[d] for d, _, _ in junk)


def test_without_references_the_base_rules_decide(spark):
    text = "word " * 10 + " ".join(f"w{i}###" for i in range(100))
    got = quality.judge(spark.createDataFrame([(1, text, None, "", ""), (2, "one two", "en", "", "")], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["kept"], r["word_far"], r["char_far"]) for r in got) == [(1, True, None, None), (2, False, None, None)]


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text(spark):
    text = "\n".join(f"line {i % 70_000} of it" for i in range(100_000))
    row = quality.judge(spark.createDataFrame([(1, text, "en", "", "")], SCHEMA)).first()
    assert (row["n_words"], row["n_dup_lines"], row["base_failed"]) == (400_000, 30_000, True)


def test_distance_by_its_definition():
    p, q = np.asarray([0.5, 0.5, 0.0]), np.asarray([0.25, 0.0, 0.75])
    want = sum(a * math.log2(a / ((a + b) / 2)) / 2 for x, y in ((p, q), (q, p)) for a, b in zip(x, y, strict=True) if a > 0)
    assert abs(quality.distances(p[None, :], q)[0] - math.sqrt(want)) < 1e-12
    assert quality.distances(p[None, :], p)[0] == 0 and abs(quality.distances(np.asarray([[1.0, 0.0]]), np.asarray([0.0, 1.0]))[0] - 1) < 1e-12
