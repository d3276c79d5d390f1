"""Technology signatures: every pattern of every one occurs here, and the automaton finds what plain searches find."""

import random
import re

import pytest

from sitegrain.operators import tech

HTML_PATTERNS = tuple(p["html"] for _, _, p in tech.SIGNATURES if "html" in p)

def shortest(parsed):
    """A short text that a parsed pattern matches."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name in ("ANY", "NOT_LITERAL"):
            out += "w"
        elif name == "IN":
            kind, first = value[0]
            out += {"LITERAL": lambda: chr(first), "RANGE": lambda: chr(first[0]), "NEGATE": lambda: "w", "CATEGORY": lambda: {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " "}.get(str(first), "w")}[str(kind)]()
        elif name == "BRANCH":
            out += shortest(value[1][0])
        elif name == "SUBPATTERN":
            out += shortest(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += shortest(value[2]) * value[0]
        elif name != "AT":
            raise ValueError(name)
    return out


def sample(pattern):
    text = shortest(re._parser.parse(pattern))
    assert re.search(pattern, text, re.I | re.A), pattern
    return text


def test_literals_are_in_every_match():
    assert tech.literals(r"static\.wixstatic\.com|wix-bolt|_wixCIDX") == ["static.wixstatic.com", "wix-bolt", "_wixcidx"]
    assert tech.literals(r"react(?:-dom)?(?:\.min)?\.js") == ["react"] and tech.literals(r"colou?r[0-9]x{2,3}yz") == ["colo"] and tech.literals("a|[b]") == ["a", ""]
    for pattern in HTML_PATTERNS:
        text = sample(pattern).lower()
        assert any(x in text for x in tech.literals(pattern)), pattern


def test_automaton_finds_what_plain_searches_find():
    random.seed(3)
    samples = [sample(p) for p in HTML_PATTERNS]
    for _ in range(300):
        text = " ".join(random.choice([random.choice(samples), random.choice(samples).upper(), random.choice(samples)[:-1], "plain İ words"]) for _ in range(random.randrange(6)))
        plain = {i: m[0] for i, p in enumerate(HTML_PATTERNS) if (m := re.search(p, text, re.I | re.A)) and m[0]}
        assert tech.first_matches(text, HTML_PATTERNS) == plain
    assert tech.first_matches("ab1", ("[0-9]", "nothing")) == {0: "1"} and tech.first_matches("x", ()) == {}


def test_every_signature_is_told_by_each_of_its_patterns(spark):
    rows, want = [], []

    def add(name, html="", generator=None, script=None, **headers):
        rows.append((len(rows), headers, generator, [script] if script else [], html))
        want.append(name)

    for name, _, patterns in tech.SIGNATURES:
        for header, pattern in patterns.get("headers", {}).items():
            add(name, **{header: sample(pattern)})
        for kind, pattern in patterns.items():
            if kind == "generator":
                add(name, generator=sample(pattern))
            elif kind == "cookies":
                add(name, **{"set-cookie": sample(pattern)})
            elif kind == "scripts":
                add(name, script="https://e.com/" + sample(pattern).strip("^$"))
            elif kind == "html":
                add(name, html="<p>" + sample(pattern) + "</p>")
    pages = spark.createDataFrame(rows, "id int, headers map<string,string>, generator string, scripts array<string>, html string")
    found = {}
    for r in tech.detect_technologies(pages, "id").collect():
        found.setdefault(r["id"], set()).add(r["name"])
    assert len(set(want)) == len(tech.SIGNATURES)
    assert [(i, n) for i, n in enumerate(want) if n not in found.get(i, ())] == []


@pytest.mark.parametrize("html", [None, "", "x" * 100_000])
def test_pages_without_evidence(spark, html):
    page = spark.createDataFrame([(1, None, None, None, html)], "id int, headers map<string,string>, generator string, scripts array<string>, html string")
    assert tech.detect_technologies(page, "id").collect() == []
