"""Rules against the plain patterns, gradients, the tagger's recall and how windows are reconciled."""

import hashlib
import random
import re

import numpy as np
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegrain.llm import personal_data as pd
from sitegrain.llm.queries import QUERIES
from sitegrain.llm.tagger import Tagger, classes


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["4111 1111 1111 1111", "@", ".", "a@b.c", "1.2.3.4", "256", "+1 (234) 555-1212", "-", " ", "٣", "é", "_", "%", "(", "0"]), st.text(alphabet="09.@a+- ()é", max_size=8)), max_size=12))
def test_rules_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert [(pd.KINDS[k], a, b) for k, a, b in pd.rule_spans(text)] == plain(text)


def test_long_runs_stay_linear():
    for text in ("0" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1(" * 100_000, "@" * 300_000):
        pd.rule_spans(text)


def test_gradients():
    r = np.random.default_rng(0)
    tagger, w, y = Tagger(3, 4, 3, 1), r.integers(0, 130, (4, 7)), r.integers(0, 3, (4, 7))
    _, grads = tagger.loss(w, y)
    for name, p in tagger.p.items():
        at = (w[0, 0], 1) if name == "chars" else tuple(r.integers(0, s) for s in p.shape)
        p[at] += 1e-5
        up = tagger.loss(w, y)[0]
        p[at] -= 2e-5
        down = tagger.loss(w, y)[0]
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_decoding_finds_the_best_path():
    tagger, w = Tagger(3, 4, 3, 2), np.random.default_rng(3).integers(0, 130, (5, 4))
    tagger.p["move"], tagger.p["first"] = np.random.default_rng(4).normal(size=(3, 3)), np.array([0.1, 0.5, -0.3])
    e, _ = tagger.emissions(w)
    score = lambda i, t: tagger.p["first"][t[0]] + sum(e[s, i, x] for s, x in enumerate(t)) + sum(tagger.p["move"][a, b] for a, b in zip(t, t[1:], strict=False))
    for i, path in enumerate(tagger.decode(w)[0].tolist()):
        assert path == list(max(np.ndindex(3, 3, 3, 3), key=lambda t: score(i, t)))


def test_reconcile_takes_the_highest_total():
    r = random.Random(2)
    for _ in range(100):
        spans = [(r.choice([-1.0, 1.0, 2.5, 4.0]), r.randrange(4), a := r.randrange(30), a + r.randint(1, 9)) for _ in range(8)]
        got = pd.reconcile(spans)
        value = {}
        for s, k, a, b in spans:
            value[k, a, b] = max(s, value.get((k, a, b), s))
        best = 0.0
        for bits in range(256):
            own = sorted((s for i, s in enumerate(spans) if bits >> i & 1), key=lambda s: s[2])
            if all(x[3] <= y[2] for x, y in zip(own, own[1:], strict=False)):
                best = max(best, sum(s[0] for s in own))
        assert abs(sum(value[s] for s in got) - best) < 1e-9


def test_tagger_learns_and_adds(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    tagger = pd.fit(docs)
    texts = [r.text for r in docs.collect()]
    found, want = pd.tagged_spans(tagger, texts), [pd.rule_spans(t) for t in texts]
    common = sum(len(set(a) & set(b)) for a, b in zip(found, want, strict=True))
    assert common >= 0.9 * sum(map(len, want)) and common >= 0.85 * sum(map(len, found))
    every = pd.all_spans(tagger, texts)
    assert all(set(base) <= set(spans) and base == b for (base, spans), b in zip(every, want, strict=True))
    assert all(not spans for (_, spans), t in zip(every, texts, strict=True) if not re.search("[0-9@]", t))
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a.b@c.de, +1 (234) 555-1212" + " x" * 40_000 + " 10.0.0.1", "x"), (None, "10.0.0.1", "x")]
    odd = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans string, kind int")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pd.find(odd, tagger).collect()}
    assert got == {1: [], 2: [], 3: plain(rows[2][1]), None: plain("10.0.0.1")}
    clean = {r.doc_id: (r.text, r.spans, r.kind) for r in pd.redact(odd, tagger).collect()}
    assert clean[1] == (None, "x", 5) and clean[3][0] == "mail [EMAIL], [PHONE]" + " x" * 40_000 + " [IP]"
    assert pd.find(odd.limit(0), pd.fit(odd.limit(0))).count() == 0


def test_query_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op3_personal_data"](spark, SMALL).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) and r.n_email == r.spans.count("email:")


def test_classes():
    assert classes("aé☃", 5).tolist() == [97, 128, 129, 130, 130]
