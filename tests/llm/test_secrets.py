"""Base spans of random texts against plain Python, and texts of very many matches."""

import re
import time

import numpy as np

from cutline.llm import secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PARTS = ["password", "Token", "api_key", "SECRET", "=", ":", " ", '"', "'", "abcdefgh1", "x", "AKIA", "ABCDEFGH12", "0123456789abcdef", "é", "日", "\n", "\r", "zz", "𝄞", ".", "-"]


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def covered(text, spans):
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_random_texts(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 60))) for _ in range(3000)] + ["é" * 3000 + " token=abcdefgh1 " * 40 + "日" * 1023]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, t in enumerate(texts):
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        mine = [(int(a), secrets.KINDS.index(k), int(z)) for k, a, z in spans]
        assert [s for s in mine if s[1] < 3] == base(t), t
        assert clean[i] == covered(t, [(a, z) for a, _, z in mine]), t


def test_a_text_of_100000_matches(spark):
    text = "é token=abcdefgh1 " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = secrets.scan(docs).first()
    assert (r.n_assign, r.spans[:13], r.spans[-22:]) == (100_000, "assign:2:17,a", "assign:1799984:1799999")
    assert secrets.redact(docs).first().text == "é [SECRET] " * 100_000
    assert time.time() - began < 120
