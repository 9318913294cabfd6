"""Gates as a whole, load status, search index, payloads, text rules and ordered queries."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from cutline import catalog
from cutline.functions import vocabulary as v
from cutline.operators import gates, search
from cutline.sources import sinks

CELLS = "source_file string, row int, institution_code string, institution_name string, program_name string, category string, stage string, section string, rank_number string, percentage string"


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_gate_of_two_files(spark):
    sl = "State Level"
    rows = [
        ("BCA_24_C1_x.csv", 0, "1", "One", "P", "GOPENH", "Stage-I", sl, "5", "90.5"),
        ("BCA_24_C1_x.csv", 1, "", " ", "", "GOPENH", "", "", "6", "nan"),
        ("BCA_24_C1_x.csv", 2, "", "", "", "GOPENH", "", "", "5", "90.5"),
        ("BCA_24_C1_x.csv", 3, "2", "Two", "Q", "government", "Stage-I", sl, "1", "1"),
        ("notes.csv", 0, "", "", "P", "G", "Stage-X", "Hall", "1", "1"),
        ("notes.csv", 1, "3", "Three", "P", "LSCS", "Stage II", sl, "1", "1"),
    ]
    got = gates.cutoff_gate(spark.createDataFrame(rows, CELLS).repartition(3), "row", ["OPEN"], ["P"], ["institution_code", "institution_name", "program_name", "section", "stage"])
    report = {r.source_file: r.asDict() for r in got["report"].collect()}
    one, notes = report["BCA_24_C1_x.csv"], report["notes.csv"]
    assert (one["n_rows"], one["filled"], one["duplicates"], one["anomaly"], one["bad_percentage"], one["bad_category"], one["bad_program"]) == (4, 10, 2, 1, 1, 0, 0)
    assert (notes["anomaly"], notes["bad_category"], notes["bad_stage"], notes["bad_section"]) == (1, 1, 0, 0)
    assert values(got["errors"]) == [("notes.csv", "FILENAME_PATTERN_MISMATCH"), ("notes.csv", "FIRST_ROW_BLANK: institution_code, institution_name")]
    assert values(got["issues"]) == [("category", "LSCS", 1)] and got["total"].first().total == 3


def test_load_status_in_order(spark):
    rows = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", None), (3, None, "x", None), (4, None, "x", None), (5, "b", "x", None), (6, "a", "z", None), (7, "a", "x", "BAD"), (8, "c", None, None)], "i int, k string, p string, bad string")
    parents = {"p": spark.createDataFrame([("x",), ("y",)], "p string")}
    target = spark.createDataFrame([("b",), (None,)], "k string")
    got = gates.load_status(rows, F.col("bad"), target, ["k"], [F.asc("i")], parents)
    want = ["inserted", "DUPLICATE_UNIQUE_KEY", "inserted", "inserted", "DUPLICATE_UNIQUE_KEY", "FOREIGN_KEY_FAILED", "BAD", "inserted"]
    assert [r.status for r in got.orderBy("i").collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 2  # one pass


def test_seat_status_of_long_codes(spark, tmp_path):
    customers = [7, 99998, 99999, 100000, 100001, 123456, 123457, 999999, 1000000]
    orders = [(i, customers[i % 9 if i % 2 else i // 9 % 9], p) for i, p in enumerate(["1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"] * 200)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["q58_seat_status"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
        want = c.sql(f"select {', '.join(got.columns)} from ({catalog.ORACLES['q58_seat_status']})").fetchall()
    assert values(got) == sorted(want, key=repr) and {"CODE_MISMATCH", "DUPLICATE_UNIQUE_KEY", "inserted"} <= {w[-1] for w in want}
    codes = spark.createDataFrame([("123456", "1234510110"), ("2113", "0211310110"), ("12345", "1234510110"), (" ", "0211310110")], "a string, b string")
    assert [tuple(r.c) for r in codes.select(v.institution_code(F.col("a"), F.col("b")).alias("c")).collect()] == [("12345", False), ("02113", True), ("12345", True), ("02113", True)]


def test_search_index_rules(spark):
    cut = "institution_code int, program_family string, year int, base_category string, is_ladies boolean, section_code string, percentile double, rank_number int"
    rows = [(1, "B", 2020 + y, "OPEN", False, "H", 90.0 + y, 7) for y in range(5)]
    rows += [(1, "B", 2024, "OPEN", False, "O", 80.0, 3), (1, "B", 2024, "OPEN", False, "O", 80.0, 9), (1, "B", 2024, "OPEN", False, "O", 80.0, None), (1, "B", 2024, "OPEN", True, "S", 10.0, 1), (1, "B", 2019, "SC", False, "H", 5.0, 1), (1, "B", 2024, "OPEN", False, "H", 0.0, 0), (2, "B", 2024, "SC", False, "H", 5.0, 1)]
    seats = spark.createDataFrame([(1, "B", 2023, True, 99), (1, "B", 2024, True, 4), (1, "B", 2024, True, 6), (1, "B", 2024, False, 70), (1, "B", 2025, False, 8)], "institution_code int, program_family string, capture_year int, is_total boolean, seats int")
    names = spark.createDataFrame([(1, "One"), (2, "Two")], "institution_code int, institution_name string")
    df = spark.createDataFrame(rows, cut)
    (r,) = search.search_index(df, seats.where("capture_year < 2025"), names).collect()  # institute 2 has no open cutoff
    assert (r.cutoff, r.percentile, r.seats) == (9, 80.0, 10)
    assert [tuple(h) for h in r.history] == [(2021, 91.0, 91.0, 7), (2022, 92.0, 92.0, 7), (2023, 93.0, 93.0, 7), (2024, 80.0, 94.0, 9)]
    assert r.years == [2019, 2020, 2021, 2022, 2023, 2024]
    assert [(o.category, o.sections) for o in r.general] == [("OPEN", ["H", "O"]), ("SC", ["H"])] and [(o.category, o.sections) for o in r.ladies] == [("OPEN", ["S"])]
    assert search.search_index(df, seats, names).first().seats is None  # the latest capture has no printed sum


def test_text_rules_of_pages(spark):
    lines = ["1102 - First", "02000 - Second", "0110224510 - Branch", "Status: Aided", "status : Private", "Home University : Some"]
    one = spark.createDataFrame([(lines, ["A b", "a-B", "", None, "a b"], "Stage-I 5 (90) stage ii 6", "no mark", "Economically Weaker Section (EWS) Seats 6", ["x", "-1", "2.50", None, "3a"])], "l array<string>, n array<string>, s string, t string, e string, c array<string>")
    r = one.select(v.page_headings(F.col("l")).alias("h"), v.slugs(F.col("n")).alias("n"), v.stage_parts(F.col("s")).alias("s"), v.stage_parts(F.col("t")).alias("t"), v.labelled_number(F.col("e"), "Economically Weaker Section (EWS) Seats").alias("e"), v.row_numbers(F.col("c"), 2).alias("c"), v.row_numbers(F.col("c"), 3).alias("d")).first()
    assert tuple(r.h) == ("01102", "First", "0110224510", "Branch", "Aided", "Some")
    assert r.n == ["a_b", "a_b_2", "field", "field_2", "a_b_3"]
    assert [tuple(x) for x in r.s] == [("Stage-I", "5 (90)"), ("stage ii", "6")] and [tuple(x) for x in r.t] == [("", "no mark")]
    assert (r.e, r.c, r.d) == (6.0, [-1.0, 2.5], None)
    texts = {name: code for name, code in v.SECTIONS.items()} | {f"  {k.upper()} * ": c for k, c in v.SECTIONS.items() if c != "SL"} | {"state level seats": "SL", "At State Level": None, "Minority seats for non minority": "MI-NONMIN", "minority seats, minority candidates": "MI-MIN", "x": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", v.detected_section(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == texts


def test_college_payloads(spark):
    rows = spark.createDataFrame([("B", 2024, "c1", "b2", "é", 2), ("B", 2024, "c1", "b1", None, 1), ("B", 2023, "c1", "b1", "S", 9)], "course string, year int, college string, branch string, section string, n int")
    got = {r.name: r for r in sinks.college_payloads(rows, ["course", "year", "college"], ["branch", "section"], ["n"]).collect()}
    doc = json.loads(got["B:2024:c1"].document)
    assert doc == {"course": "B", "year": 2024, "college": "c1", "codes": {"branch": ["b1", "b2"], "section": ["é"]}, "rows": [{"branch": "b1", "section": None, "n": 1}, {"branch": "b2", "section": "é", "n": 2}]}
    assert got["B:2024:c1"].bytes == len(got["B:2024:c1"].document.encode()) and len(got) == 2


@pytest.mark.parametrize("name", ["q70_lookup_years", "q71_lookup_families", "q72_lookup_categories", "q105_raw_rows", "q106_detail_trend", "q107_detail_table", "q117_sorted_by_seats"])
def test_order_of_rows(spark, name):
    duck = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for t in "nation supplier part orders lineitem".split():
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    keep = [want.columns.index(c) for c in df.columns]
    got = [tuple(r) for r in df.collect()]
    assert len(got) > 1 and got == [tuple(w[i] for i in keep) for w in want.fetchall()]
