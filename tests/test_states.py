"""Releases, carried state, bands, stored states, examples, files of several layouts, merged JSON, event logs."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from cutline.functions import fields
from cutline.operators import ranges, states
from cutline.sources import scans, sinks, versions


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_promotion_that_breaks_changes_nothing(spark, tmp_path):
    root, one = f"file://{tmp_path}/r", spark.createDataFrame([(1, "a")], "k int, v string")
    assert versions.current(spark, root) is None
    with pytest.raises(versions.PromotionError):
        versions.rollback(spark, root)
    first = versions.promote(spark, root, {"x": one, "y": one})
    broken = one.withColumn("v", F.raise_error(F.lit("half-way")).cast("string"))
    with pytest.raises(Exception, match="half-way"):
        versions.promote(spark, root, {"x": one.withColumn("k", F.lit(2)), "y": broken})
    assert versions.current(spark, root) == first and values(versions.read(spark, root, "x")) == [(1, "a")]
    with pytest.raises(versions.PromotionError, match="refused"):
        versions.promote(spark, root, {"x": one}, lambda t: t["x"].where("k = 1"))
    assert [p.name for p in (tmp_path / "r/versions").iterdir()] == [first]  # what failed is removed
    second = versions.promote(spark, root, {"x": one.withColumn("k", F.lit(2))})
    assert values(versions.read(spark, root, "x")) == [(2, "a")] and values(versions.read(spark, root, "y")) == [(1, "a")]
    assert values(versions.read(spark, root, "x", first)) == [(1, "a")]
    assert versions.rollback(spark, root) == first and values(versions.read(spark, root, "x")) == [(1, "a")]
    with pytest.raises(versions.PromotionError):
        versions.rollback(spark, root)
    versions.rollback(spark, root, second)
    assert [(h["action"], h["version"]) for h in versions.history(spark, root)] == [("promote", first), ("promote", second), ("rollback", first), ("rollback", second)]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "z")


def test_two_promotions_at_once(spark, tmp_path):
    root, one = f"file://{tmp_path}/r", spark.createDataFrame([(1,)], "k int")

    def meanwhile(tables):
        versions.promote(spark, root, {"x": one.withColumn("k", F.lit(9))})
        return tables["x"].where("false")

    with pytest.raises(versions.PromotionError, match="meanwhile"):
        versions.promote(spark, root, {"x": one}, meanwhile)
    assert values(versions.read(spark, root, "x")) == [(9,)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_carried_state(spark, blocks):
    rng = random.Random(1)
    rows = [(None if i % 3 == 2 and blocks > 1 else i % blocks, i, rng.choice(["", " ", None, None, f" v{i} "]) if i > 40 else None, "x" if i == 7 else None) for i in range(4000)]
    want, last = [], {}
    for b, i, x, y in rows:
        for k, v in (("x", x), ("y", y)):
            if v and v.strip():
                last[b, k] = v.strip()
        want.append((b, i, x if x and x.strip() else last.get((b, "x")), y or last.get((b, "y"))))
    shuffled = list(rows)
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "b int, i int, x string, y string")
    got = ranges.carried(df, ["x", "y"], ["i"], ["b"] if blocks > 1 else [])
    assert got.columns == df.columns and values(got) == sorted(want, key=repr)
    assert ranges.carried(df.limit(0), ["x"], ["i"]).count() == 0


def test_band_join_with_a_hot_bucket(spark):
    rng = random.Random(2)
    left = [(i, 50.0 if i % 3 else rng.uniform(0, 100), "k" if i % 7 else None) for i in range(900)] + [(-1, None, "k")]
    right = [(i, rng.choice([45.0, 55.0, 55.01, rng.uniform(-5, 105)]), "k") for i in range(40)] + [(-1, None, "k")]
    a, b = spark.createDataFrame(left, "i int, x double, g string"), spark.createDataFrame(right, "j int, y double, g string")
    for keys in ([], ["g"]):
        bb = b if keys else b.drop("g")
        got = ranges.band_join(a, bb, "x", "y", 5, keys, most=50)
        want = [(i, j) for i, x, g in left for j, y, h in right if x is not None and y is not None and abs(x - y) <= 5 and (not keys or g == h)]
        assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranges.band_join(a.limit(0), b.drop("g"), "x", "y", 5).count() == 0


def test_refresh_keeps_the_files_of_other_partitions(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", [(k % 5, y, float(k)) for k in range(200) for y in (2020, 2021, None)]
    df = spark.createDataFrame(rows, "k int, y int, v double")
    args = (["k", "y"], "y", {"low": "v"}, {"high": "v"})
    states.refresh(path, df.where("v > 100"), *args)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    for _ in range(2):
        got = states.refresh(path, df.where("v <= 100 and y = 2021"), *args)
    after = set((tmp_path / "t").rglob("*.parquet"))
    assert {p for p in before if "2021" not in str(p)} <= after and not {p for p in before if "2021" in str(p)} & after
    loaded = df.where("v > 100 or y = 2021")
    assert values(got.select("k", "y", "low", "high")) == values(loaded.groupBy("k", "y").agg(F.min("v"), F.max("v")))


def test_first_examples(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), rng.randrange(900), i) for i in range(5000)] + [("c", None, -1)]
    got = states.first_examples(spark.createDataFrame(rows, "kind string, at int, i int").repartition(7), "kind", ["at", "i"], 20)
    want = []
    for kind in ("a", "b", None, "", "c"):
        mine = sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        want += [(*r, n) for n, r in enumerate(mine[:20], 1)]
    assert values(got) == sorted(want, key=repr)
    assert states.first_examples(got.drop("example").limit(0), "kind", ["at"], 3).count() == 0


def test_files_of_other_writers(spark, tmp_path):
    cells = [["007", 'say "hi", x', ""], ["", "line\nbreak", " kept "], ["2", "plain", "é"]]
    for name, columns, mark in (("a.csv", ["code", "name", "note"], "﻿"), ("b.csv", ["note", "code", "name"], ""), ("c.csv", ["name", "code"], "")):
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
            f.write(mark)
            out = csv.writer(f)
            out.writerow(columns)
            out.writerows([dict(zip(["code", "name", "note"], c, strict=True))[x] for x in columns] for c in cells)
    paths = scans.files(spark, f"file://{tmp_path}")
    got = scans.strings(spark, paths, ["code", "name", "note"], ["code"])
    want = [(*c[:2], c[2] if f != "c.csv" else "", f) for f in ("a.csv", "b.csv", "c.csv") for c in cells]
    assert values(got) == sorted(map(tuple, want), key=repr)
    assert values(scans.missing_report(spark, paths, ["code", "note"])) == [("c.csv", ["note"])]
    with pytest.raises(ValueError, match="c.csv"):
        scans.strings(spark, paths, required=["note"])
    sinks.csv(got, f"file://{tmp_path}/out", ["code", "name", "note"])
    back = []
    for p in (tmp_path / "out").glob("part-*"):
        with open(p, encoding="utf-8", newline="") as f:
            back += list(csv.reader(f))[1:]
    assert sorted(back) == sorted(list(w[:3]) for w in want)


def test_vocabulary_and_hashes(spark, tmp_path):
    (tmp_path / "v.csv").write_text("alias,full\n a ,Alpha\nb,Beta\nb,Also\n,none\n", encoding="utf-8")
    words = scans.vocabulary(spark, f"file://{tmp_path}/v.csv", "alias", "full")
    rows = spark.createDataFrame([("a ",), ("b",), ("c",), (None,)], "x string")
    for small in (100, 1):
        assert values(scans.listed(rows, "x", words, "word", small)) == sorted([("a ", "Alpha"), ("b", "Also"), ("c", None), (None, None)], key=repr)
    (tmp_path / "w.csv").write_text("alias,full\n a ,Alpha\nb,Beta\nb,Also\n,none\n", encoding="utf-8")
    (tmp_path / "x.csv").write_bytes(b"")
    got = {r.source_file: (r.size, r.copies) for r in scans.hashed(spark, f"file://{tmp_path}", "*.csv").collect()}
    assert got == {"v.csv": (41, 2), "w.csv": (41, 2), "x.csv": (0, 1)}


def test_wide_columns_in_first_seen_order(spark):
    rows = [("p", "z", 1, 3), ("p", "a", 2, 1), ("q", "m", 3, 2), ("q", "z", 4, 9), (None, None, 5, 0)]
    df = spark.createDataFrame(rows, "base string, key string, value int, at int").repartition(4)
    got = sinks.wide(df.where("key is not null"), ["base"], "key", "value", ["at"])
    assert got.columns == ["base", "a", "m", "z"] and values(got) == [("p", 2, None, 1), ("q", None, 3, 4)]
    assert sinks.first_seen(df, "key", ["at"]) == ["a", "m", "z"]
    with pytest.raises(ValueError):
        sinks.first_seen(df, "key", ["at"], 2)
    with pytest.raises(Exception, match="several rows"):
        sinks.wide(df.unionByName(df), ["base"], "key", "value").collect()


def test_merged_json(spark):
    pairs = [('{"a": 1, "b": {"x": 1}, "n": 1}', '{"b": {"y": 2}, "n": null}'), (None, '{"a": "é"}'), ('{"a": 1.50}', "no json"), (None, None)]
    got = spark.createDataFrame(pairs, "l string, r string").select(fields.json_merge(F.col("l"), F.col("r")).alias("m")).collect()
    assert [json.loads(r.m) for r in got] == [{"a": 1, "b": {"y": 2}, "n": None}, {"a": "é"}, {"a": 1.5}, {}]


def test_numbers(spark):
    cells = ["1", " 2.5 ", "-.5", "1e3", "nan", "Infinity", "12d", "1_0", "", None, "7."]
    got = [r.d for r in spark.createDataFrame([(c,) for c in cells], "c string").select(fields.safe_double(F.col("c")).alias("d")).collect()]
    assert got == [1.0, 2.5, -0.5, 1000.0, None, None, None, None, None, None, 7.0]


def test_event_log_and_totals(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    batch = spark.createDataFrame([("a", 2), ("b", 1), ("a", 5)], "id string, at int")
    assert values(states.append_events(path, batch, "id", ["at"])) == [("a", 2, 2), ("b", 1, 1)]
    more = spark.createDataFrame([("c", 0), ("a", 9)], "id string, at int")
    for _ in range(2):
        assert values(states.append_events(path, more, "id", ["at"])) == [("a", 2, 2), ("b", 1, 1), ("c", 0, 3)]
    with pytest.raises(ValueError):
        states.append_events(path, spark.createDataFrame([(None, 1)], "id string, at int"), "id", ["at"])
    seats = spark.createDataFrame([("i", "l", "x", 2), ("i", "l", None, 3), ("j", "l", "x", 4)], "i string, lane string, cat string, n int")
    got = states.with_totals(seats, ["i", "lane"], "cat", F.col("n"))
    assert values(got) == sorted([("i", "l", "x", 2, False), ("i", "l", None, 3, False), ("i", "l", None, 5, True), ("j", "l", "x", 4, False), ("j", "l", None, 4, True)], key=repr)
