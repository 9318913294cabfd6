"""The Merkle manifest against a plain recursive tree, and its SQL."""

from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from cutline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, path string, k string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes, fanout):
    return [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(up(out[-1], fanout))
    return out


def walk(levels, i, fanout, current):
    """Siblings of leaf i, and the top folded from current."""
    found = []
    for nodes in levels[:-1]:
        run = nodes[i - i % fanout : i - i % fanout + fanout]
        others = run[: i % fanout] + run[i % fanout + 1 :]
        found += others
        current = h(*others[: i % fanout], current, *others[i % fanout :])
        i //= fanout
    return found, current


def brute(rows, fanout):
    groups = {}
    for d, text, lang, source, n in rows:
        hit = d is not None and crc32(str(d).encode()) % 7 == 0
        claim = n + 1 if hit and n is not None else n
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf([d, source, lang, n, text]), leaf([d, source, lang, claim, text])))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([g[2] for g in sorted(groups[x])], fanout) for x in names}
    crown = tree([trees[x][-1][0] for x in names], fanout)
    out = []
    for place, x in enumerate(names):
        for i, (real, d, a, b) in enumerate(sorted(groups[x])):
            low, top = walk(trees[x], i, fanout, b)
            high, top = walk(crown, place, fanout, top)
            out.append((d if real else None, a, trees[x][-1][0], crown[-1][0], h(*low, *high), top, top == crown[-1][0]))
    return sorted(out, key=repr)


def rows_of(n):
    langs = ["en"] * 6 + ["de", None, "", "日本", "z"]
    out = [(i * 3, f"text {i} é" if i % 4 else None, langs[i % 11], None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i) for i in range(n)]
    return [*out, (None, "no id", "en", "s", 7), (None, "", "en", None, None), (3, "again", "en", "s", 1), (3, "again", "en", "s", 1), (2**63 - 1, "x" * 300_000, "en", "", 2**63 - 1)]


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 12, 150), (2, 1, 90), (3, 2, 150), (2, 3, 0)])
def test_manifest_against_plain_trees(spark, fanout, levels, n):
    rows = rows_of(n)
    docs = spark.createDataFrame([(*r, 1, "p", "k") for r in rows], SCHEMA).repartition(3)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(38,0)")
    got = merkle.manifest(docs, claimed={"n_chars": F.when(hit, more + 1).otherwise(more)}, fanout=fanout, levels=levels)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, fanout)


def test_empty_one_row_and_proofs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.op11_merkle(empty).count() == 0
    one = merkle.op11_merkle(spark.createDataFrame([(1, "a", None, "s", 1, 1, "p", "k")], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h() and one.verified
    got = merkle.manifest(spark.createDataFrame([(*r, 1, "p", "k") for r in rows_of(40)], SCHEMA), levels=2, proofs=True).collect()
    for r in got:
        current = r.leaf
        for step in r.path:
            others = step.others.decode()
            current = h(others[: 64 * step.place], current, others[64 * step.place :])
        assert current == r.root and r.verified


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = merkle.op11_merkle(spark.read.parquet(f"{sf}/documents.parquet"))
    want = duck.sql(f"select {', '.join(got.columns)} from ({merkle.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
