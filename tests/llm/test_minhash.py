"""MinHash near duplicates against brute force, and the guarantee of the multi-index."""

from itertools import pairwise

import numpy as np
import pytest

from cutline.llm import minhash
from tests.llm.test_ops import LONG, brute_components, near_copies

SCHEMA = "doc_id long, text string, kept string, n int, node int, bits int, component_id string"


def test_all_pairs_within_the_limit_share_a_key():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 16, (4000, minhash.SYMBOLS)).astype(np.uint16)
    y = x.copy()
    for row in y:
        row[rng.choice(minhash.SYMBOLS, minhash.LIMIT, replace=False)] ^= np.uint16(1 + rng.integers(0, 1 << 15))
    for row, other in zip(y[:2000], x[:2000], strict=True):  # the hardest case: errors spread evenly over the chunks
        row[:] = other
        for c in range(minhash.CHUNKS):
            n = minhash.ERRORS + 1 if c else minhash.ERRORS
            row[c * minhash.WIDTH + rng.choice(minhash.WIDTH, n, replace=False)] ^= np.uint16(7)
    assert ((x != y).sum(1) == minhash.LIMIT).all()
    a, b = minhash.keys_of(x), minhash.keys_of(y)
    assert all(np.intersect1d(p, q).size for p, q in zip(a, b, strict=True))
    assert all(not np.intersect1d(p, q).size for p, q in pairwise(a))


def test_distances_follow_the_similarity():
    rng = np.random.default_rng(1)
    for n in (5, 45, 450):
        far = []
        for _ in range(400):
            pool = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            a, b = pool[: -max(1, n // 9)], pool[max(1, n // 9) :]
            s = minhash.signatures([np.sort(a), np.sort(b)])
            far.append((s[0] != s[1]).sum())
        want = minhash.SYMBOLS * (1 - (n - 2 * max(1, n // 9)) / n)
        assert abs(np.mean(far) - want) < 1 and max(far) <= want + 6.5 * np.sqrt(want)


@pytest.mark.parametrize("contract", [(4, 80), (5, 90)])
def test_brute_force(spark, contract):
    rng = np.random.default_rng(7)
    cases = [(1, 500, 90, 6), (2, 60, 700, 40), (3, 120, 24, 2), (40, 3, 12, 1)]
    rows = [(10000 * k + i, t if k % 2 else t.replace("w", f"v{k}")) for k, case in enumerate(cases) for i, t in near_copies(rng, *case)]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.duplicates(spark.createDataFrame(rows, "doc_id long, text string"), *contract).collect()}
    assert got == {i: (c, i == c) for i, c in brute_components(rows, *contract).items()}


def test_edges(spark):
    a, b = "a b c d e f g h", "P q r s t u v w"
    rows = [(i, a) for i in range(10, 210)] + [(None, a), (None, b.lower()), (7, b), (7, "k l m n o x y z"), (3, None), (3, ""), (2, " \t"), (1, "one two"), (5, "ONE  two"), (4, LONG), (6, LONG + " end"), (None, "only this one has no number")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA)
    got = minhash.duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by_id[10] == {(4, 10, True)} and by_id[209] == {(4, 10, False)}
    assert by_id[None] == {(4, 10, False), (4, 7, False), (2, None, True)}
    assert by_id[7] == {(4, 7, True)} and by_id[3] == {(0, 3, True)} and by_id[2] == {(0, 2, True)}
    assert by_id[1] == {(1, 1, True)} and by_id[5] == {(1, 1, False)}
    assert {c for _, c, _ in by_id[4] | by_id[6]} == {4}
    assert minhash.duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.duplicates(docs, 4, 50)
