"""The filter audit against plain Python and its SQL."""

import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cutline.llm import filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, digest string, part string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return sum(f << k for k, f in enumerate(tests))


def brute(rows, labels):
    docs = []
    for d, text, source in rows:
        text = text or ""
        copy = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows)
        good, toxic = (any(l[0] == d and d is not None and l[k] == 1 for l in labels) for k in (1, 2))
        docs.append((source or "", fails_of(text) | copy << 4, good, toxic))
    out = []
    for part in sorted({d[0] for d in docs}):
        mine, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            here = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in here if d[1] & bit]
                here = [d for d in here if not d[1] & bit]
                earlier = sum(bool(d[1] & bit) for d in mine) - len(gone)
                shapley[letter] += len(gone)
                lines.append((part, "".join(order), step, len(here), len(gone), earlier, sum(d[1] == bit for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), letter))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_against_plain_python(spark):
    many = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "  \t ", many, many + " #", many.upper(), "w " * 80, "w " * 80 + "$", "é" * 200_000 + " " + many, ("z" * 99 + " ") * 70, "Ab c", "日本 語\x0b語 日本"]
    rows = [(i, t, ["a", "b", None, ""][i % 4]) for i, t in enumerate(texts * 2)]
    rows += [(None, many, "a"), (None, None, "c"), (3, many, "b"), (3, many, "b"), (3, "other", "b"), (-5, "w " * 80, "b")]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1), (15, 1, None)]
    docs = spark.createDataFrame([(d, t, "en", s, 1, 7, "x", "y") for d, t, s in rows], SCHEMA).repartition(3)
    got = filters.audit(docs, spark.createDataFrame([(*l, "z") for l in labels], LABELS))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filters.audit(spark.createDataFrame([], SCHEMA), none).count() == 0
    one = spark.createDataFrame([(1, "a b", None, None, 1, 7, "x", "y")], SCHEMA)
    got = sorted(map(tuple, filters.audit(one, none).collect()))
    assert got == brute([(1, "a b", None)], [])


WORD = st.text(alphabet=st.sampled_from("aAé日 \t\x0b\x85#b"), max_size=90)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), WORD), max_size=8))
def test_masks_of_random_texts(texts):
    column = pa.array(["cut", *texts], pa.string())[1:]
    assert filters.masks(filters.Texts(column)).tolist() == [fails_of(t or "") for t in texts]


def test_equal_hashes_are_verified():
    texts = ["a b a", "c", "long" * 40 + " b " + "long" * 40]
    t = filters.Texts(pa.array(texts))
    assert t.distinct(np.zeros(7, np.uint64)).tolist() == t.distinct(t.hashes()).tolist() == [2, 1, 2]


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    got = filters.audit(*(spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels")))
    want = duck.sql(f"select {', '.join(got.columns)} from ({filters.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
