"""Names, contacts, seat tables, selections and audits on small rows, by their rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cutline import catalog
from cutline.operators import gates, naming, search
from cutline.operators import relational as op
from cutline.sources import scans, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_canonical_names(spark):
    given = [("1", "Old", 2022)] * 3 + [("1", " New ", 2023), ("1", "Other", 2023), ("1", "Other", 2023), ("2", "b", 2021), ("2", "a", 2021), ("3", " ", 2023), (" ", "x", 2023), (None, "x", 2023), ("4", None, 2023)]
    got = naming.canonical_names(spark.createDataFrame(given, "institution_code string, institution_name string, year int"))
    assert rows(got["names"]) == [("1", "Other", 2023, 3), ("2", "a", 2021, 2)]
    assert rows(got["variants"]) == [("1", "New", 1), ("1", "Old", 3), ("2", "b", 1)]
    stored = spark.createDataFrame([("1", "was", "Pune"), ("9", "kept", None)], "institution_code string, institution_name string, city string")
    assert rows(naming.with_names(stored, got["names"])) == [("1", "Other", "Pune"), ("2", "a", None), ("9", "kept", None)]
    assert naming.canonical_names(spark.createDataFrame([], "institution_code string, institution_name string, year int"))["names"].isEmpty()


def test_contacts(spark):
    stored = spark.createDataFrame([("1", "Alpha College"), ("2", "Beta"), ("4", "Gamma")], "institution_code string, institution_name string")
    stored = op.with_columns(stored, {"city": F.lit(""), "website": F.lit("")})
    listed = [("1, 2", "ALPHA-college", "P", "unknown", 0), ("1", "Alpha College", "P ", "site", 1), ("4,5", "Gamma", "P", "", 2), ("4", "Gamma", "Q", "x", 3), ("1,", "Alpha", "P", "later", 4)]
    got = naming.contacts(stored, spark.createDataFrame(listed, "codes string, name string, city string, website string, idx int"), "idx")
    assert rows(got["institutes"]) == [("1", "Alpha College", "P", "site"), ("2", "Beta", "", ""), ("4", "Gamma", "", "")]
    assert rows(got["quarantined"]) == [("", "CODE_NOT_IN_DB", "Alpha"), ("2", "NAME_MISMATCH", "Beta / ALPHA-college"), ("4", "CITY_CONFLICT", "P=Gamma; Q=Gamma"), ("5", "CODE_NOT_IN_DB", "Gamma")]
    assert rows(naming.contacts(stored, spark.createDataFrame([], "codes string, name string, city string, website string, idx int"), "idx")["institutes"]) == rows(stored)


def test_seat_tables(spark):
    given = [
        (0, "1", "a", "HU", "Total", "", "9.0"), (1, "1", "a", "HU", "OPEN", "G", "3"), (2, "1", "a", "HU", "OPEN", "G", "4"), (3, "1", "a", "HU", "ZZ", "L", "x"), (4, "1", "a", "HU", "AA", "", "2"),
        (5, "1", "a", "Zed", "OPEN", "L", "1"), (6, "1", "a", " State Level", "OPEN", None, "5"), (7, "1", "", "HU", "OPEN", "G", "1"), (8, None, "a", "HU", "OPEN", "G", "1"),
    ]
    df = spark.createDataFrame(given, "k int, institution_code string, choice_code string, allocation_type string, category string, gender string, seats string")
    got = sinks.seat_tables(df, ["k"], ["State Level", "HU"], ["OPEN", "Total"]).collect()
    assert len(got) == 1 and [t.allocation_type for t in got[0].tables] == ["State Level", "HU", "Zed"]
    assert [tuple(r) for r in got[0].tables[1].rows] == [("OPEN", 4, None, None), ("Total", None, None, 9), ("AA", None, None, 2)]
    assert [tuple(r) for r in got[0].tables[0].rows] == [("OPEN", None, None, 5)]


def test_trend_documents(spark):
    given = [("B", 1, "P", "c", "O", False, "HU", 2023, 2, 50.123456, 9), ("B", 1, "P", "c", "O", False, "HU", 2023, 1, 60.0, 8), ("B", 1, "P", "c", "O", False, "HU", 2023, 2, 49.99999, 7), ("B", 1, "P", "c", "O", False, "HU", 2022, 1, 0.0, 0)]
    df = spark.createDataFrame(given, "family string, program_id int, program_name string, college string, base_category string, is_ladies boolean, section_code string, year int, round int, percentile double, rank_number int")
    points = search.closing_points(df, ["family", "program_id", "program_name", "college", "base_category", "is_ladies", "section_code"])
    doc = sinks.trends(points, ["family", "college"], ["program_id", "base_category", "is_ladies", "section_code"], {"program_id": "program_name"}, ["base_category"]).collect()[0]
    got = json.loads(doc.document)
    assert doc.name == "B:c" and doc.bytes == len(doc.document.encode()) and got["codes"] == {"program_id": {"1": "P"}, "base_category": ["O"]}
    assert got["groups"][0]["points"] == [{"year": 2023, "round": 1, "percentile": 60.0, "rank": 8}, {"year": 2023, "round": 2, "percentile": 50.0, "rank": 9}]
    assert rows(search.round_series(points, ["college"])) == [("c", 1, [(2023, 60.0)]), ("c", 2, [(2023, 50.0)])]


def test_flags_keep_all_rows(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("a", None, "x"), ("b", 5.0, None)], "k string, v double, c string")
    assert [r.is_selected for r in search.flagged(df, c=["x"]).collect()] == [True, False, True, False]
    assert [r.is_selected for r in search.flagged(df, c=[], k=None).collect()] == [True] * 4
    assert rows(search.chosen_range(search.flagged(df, c="x"), ["k"], "v")) == [("a", 1.0, 1.0, 2), ("b", None, None, 0)]
    assert rows(search.matching(df, c=["x", "y"], k=None)) == rows(df.where("c is not null"))


@pytest.mark.parametrize(
    ("name", "found"),
    [
        ("mba_2024_C2.pdf", ("CUTOFFS", "MBA", 2024, "C2", 1.0)), ("BBA-24 seat.pdf", ("SEATS", "BBA", 2024, None, 2 / 3)), ("XMCAX_SM.pdf", ("SEATS", "MCA", None, None, 1 / 3)),
        ("notes_1999_AC1.pdf", ("CUTOFFS", None, None, None, 0.0)), ("", ("CUTOFFS", None, None, None, 0.0)),
    ],
)
def test_identified(spark, name, found):
    got = scans.identified(spark.createDataFrame([(name,)], "f string"), F.col("f")).first()
    assert tuple(got)[1:5] == found[:4] and abs(got.confidence - found[4]) < 1e-9


def test_audit_and_times(spark):
    done = spark.createDataFrame([("f", 1, "ocr"), ("f", 1, "native"), ("f", 1, "ocr")], "source_file string, page int, method string")
    bad = spark.createDataFrame([("f", 2), ("f", 1)], "source_file string, page int")
    assert rows(gates.page_audit(done, bad)) == [("f", 1, 3, 1, "native+ocr"), ("f", 2, 0, 1, "")]
    stamped = op.stamped(done)
    assert stamped.where("created_at is null").isEmpty() and stamped.select("created_at").distinct().count() == 1
    given = spark.createDataFrame([("2020-01-01 00:00:00",), (None,)], "t string").selectExpr("cast(t as timestamp) as created_at")
    assert sorted(r.created_at.year == 2020 for r in op.stamped(given).collect()) == [False, True]


def test_orders(spark):
    df = spark.createDataFrame([("1", "b", 5.0, None), ("2", "a", 9.0, 3), ("3", "c", 9.0, 7)], "institution_code string, institution_name string, highest_cutoff double, seats int")
    order = lambda by: [r.institution_code for r in search.sorted_results(df, by).collect()]
    assert (order("percentile"), order("name"), order("seats")) == (["2", "3", "1"], ["2", "1", "3"], ["3", "2", "1"])


def test_nested_documents_by_lines(spark, tmp_path):
    given = [(c, y, i, p, 0.5 * p) for c in ("A", 'B"\\', None) for y in (2023, 2022, None) for i in (2, 10) for p in (3, 1, 3, 2)]
    df = spark.createDataFrame(given, "course string, yr int, inst bigint, prog bigint, pct double").repartition(3)
    lines = sinks.wrapped_lines(sinks.nested(df, "course", ["yr", "inst"], ["prog", "pct"]), "DATA", "course")
    ordered = lines.orderBy("course", "part", "yr", "inst").collect()
    points = [{"prog": p, "pct": 0.5 * p} for p in (1, 2, 3, 3)]
    for course in ("A", 'B"\\', None):
        script = [r.line for r in ordered if r.course == course]
        name, text = re.fullmatch(r'window\.DATA\[("(?:[^"\\]|\\.)*")\]=(.*);', "\n".join(script), re.DOTALL).groups()
        own = {} if course is None else {"course": course}
        groups = [{"yr": y, "inst": i, "points": points} if y else {"inst": i, "points": points} for y in (None, 2022, 2023) for i in (2, 10)]
        assert json.loads(name) == (course or "null") and json.loads(text) == own | {"codes": {"yr": [2022, 2023], "inst": [2, 10]}, "groups": groups}
        assert len(script) == 8 and all(s.count('"points"') <= 1 for s in script)  # no row holds more than one group
    df.withColumnsRenamed({"course": "l_returnflag", "inst": "l_suppkey", "prog": "l_partkey", "pct": "l_extendedprice"}).withColumn("l_shipdate", F.make_date("yr", F.lit(1), F.lit(1))).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["q65_nested_documents"](spark, str(tmp_path))
    assert rows(got) == sorted(((c, y, i, 4) for c in ("A", 'B"\\', None) for y in ("2022", "2023", None) for i in ("2", "10")), key=repr)
