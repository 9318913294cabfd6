from pyspark.sql import functions as F

from cutline.functions import fields
from cutline.operators import relational as op


def test_categories(spark):
    cases = {"GOPENH": ("OPEN", False, "HU"), "LSCS": ("SC", True, "SL"), "PWDROBCH": ("PWDROBC", False, "HU"), "GNTAO": ("NTA", False, "OHU"), "PWD": ("PWD", False, "SL"), "MI-MH": ("MI", False, "SL"), "ORPHANI": ("ORPHAN_INST", False, "SL"), " gopenh ": ("OPEN", False, "HU"), "": None, "L": None, "G": None, "S": None, "LH": None}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", fields.decompose_category(F.col("c")).alias("d"))
    assert {r.c: r.d and tuple(r.d) for r in df.collect()} == cases


def test_insert_new_keeps_null_keys(spark):
    batch = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (None, 5), (2, 5)], "a int, b int")
    got = op.insert_new(batch, spark.createDataFrame([(2, 5)], "a int, b int"), ["a", "b"], [F.asc("b")])
    assert sorted((r.a or 0, r.status) for r in got.collect()) == [(0, "inserted"), (0, "inserted"), (1, "duplicate"), (1, "inserted"), (2, "duplicate")]


def test_update_matched_takes_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = op.update_matched(t, spark.createDataFrame([(1, None), (3, "x")], "k int, v string"), ["k"], ["v"])
    assert sorted((r.k, r.v or "-") for r in got.collect()) == [(1, "-"), (2, "b")]


def test_get_or_create_numbers_on(spark):
    dim = spark.createDataFrame([("a", "x", 7)], "f string, n string, id long")
    rows = spark.createDataFrame([("b", "y"), ("a", "x"), ("a", "z"), ("b", "x"), ("a", "z")], "f string, n string")
    got = op.get_or_create(dim, rows, ["f", "n"], "id")
    assert sorted(map(tuple, got.collect())) == [("a", "x", 7), ("a", "z", 8), ("b", "x", 9), ("b", "y", 10)]


def test_enrichment(spark):
    listed = spark.createDataFrame([("1, 2", "p", None, 0), ("2,3", "p", "s2", 1), ("4", "p", None, 2), ("4,", "q", "s4", 3)], "codes string, city string, site string, idx int")
    got = op.enrichment(listed, spark.createDataFrame([("1",), ("2",), ("4",)], "code string"), "codes", "city", "site", "idx")
    assert sorted((r.code, r.site, r.status) for r in got.collect()) == [("1", None, "ok"), ("2", "s2", "ok"), ("3", "s2", "CODE_NOT_IN_DB"), ("4", None, "CITY_CONFLICT")]


def test_text_fields(spark):
    df = spark.createDataFrame([("GOPENH  LSCS\r\n\n\n\nIV\tSTAGE\n 12 (3.5) 7B (80.25)\0x ",), (None,)], "t string")
    rows = df.select(fields.text_lines(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [["GOPENH LSCS", "IV STAGE", "12 (3.5) 7B (80.25) x"], []]
    line = spark.createDataFrame([("GOPENH LSCS",), ("IV STAGE",), ("12 (3.5) 7B (80.25) x",)], "l string")
    got = line.select(fields.is_category_line(F.col("l")).alias("c"), fields.ranked_values(F.col("l")).alias("v")).collect()
    assert [r.c for r in got] == [True, False, False]
    assert [tuple(v) for v in got[2].v] == [(12, "", 3.5), (7, "B", 80.25)]


def test_name_ratio_equals_difflib(spark):
    from difflib import SequenceMatcher

    names = [("Govt. College, Pune", "GOVT COLLEGE PUNE"), ("A-1", "zz"), (None, "X"), ("", "")]
    a, b = fields.normal_name(F.col("a")), fields.normal_name(F.col("b"))
    got = spark.createDataFrame(names, "a string, b string").select(a.alias("x"), b.alias("y"), fields.name_ratio(a, b).alias("r")).collect()
    assert (got[0].x, got[0].r) == ("GOVT COLLEGE PUNE", 1.0)
    assert [r.r for r in got] == [None if r.x is None or r.y is None else SequenceMatcher(None, r.x, r.y).ratio() for r in got]


def test_check_steps(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "b")], "u int, t int, s string")
    got = op.check_steps(df, ["u"], ["t"], "s", {"a": ["b"]}, ["a"])
    assert sorted((r.u, r.t, r.allowed) for r in got.collect()) == [(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, False)]


def test_keys_with_nulls(spark):
    t = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "a int, b int")
    assert sorted((r.b, r.duplicate) for r in op.flag_duplicates(t, ["a"]).collect()) == [(1, True), (2, True), (3, False)]
    dim = spark.createDataFrame([("x", None, 4)], "f string, n string, id long")
    new = spark.createDataFrame([(None, "p"), ("x", None), (None, None)], "f string, n string")
    assert sorted(r.id for r in op.get_or_create(dim, new, ["f", "n"], "id").collect()) == [4, 5, 6]
    patch = spark.createDataFrame([(1, 9), (1, 8), (None, 7)], "a int, b int")
    assert sorted((r.a or 0, r.b) for r in op.upsert(t, patch, ["a"], [F.desc("b")]).collect()) == [(0, 7), (1, 9)]


def test_text_rules(spark):
    from cutline.functions import vocabulary as v

    df = spark.createDataFrame([("a\rb\r\nc",)], "t string")
    assert df.select(fields.text_lines(F.col("t"))).first()[0] == ["a", "b", "c"]
    line = spark.createDataFrame([("02113 - Some College ", "12 (3) 7b (80.25)", "Intake: 60", "x Stage-I y stage II z", "1 2 3")], "h string, v string, n string, s string, c string")
    r = line.select(v.headings(F.col("h")).alias("h"), fields.ranked_values(F.col("v")).alias("v"), v.labelled_number(F.col("n"), "intake").alias("n"), v.stage_parts(F.col("s")).alias("s"), v.numeric_cells(F.col("c"), 3).alias("c"), v.numeric_cells(F.col("c"), 2).alias("d")).first()
    assert (r.h.institute, r.h.institute_name, r.h.program, r.n, r.c, r.d) == ("02113", "Some College", None, 60.0, [1, 2, 3], None)
    assert [tuple(x) for x in r.v] == [(12, "", 3.0), (7, "b", 80.25)] and [tuple(x) for x in r.s] == [("", "x"), ("Stage-I", "y"), ("stage II", "z")]
    assert spark.createDataFrame([(["12", "(3.5)", "x", "(4)", "(5)"],)], "l array<string>").select(v.merged_lines(F.col("l"))).first()[0] == ["12 (3.5)", "x", "(4)", "(5)"]


def test_scans(spark, tmp_path):
    from cutline.sources import scans

    (tmp_path / "MCA_25_C2_x.csv").write_text("\ufeffcode,name\n007,\n,b\n", encoding="utf-8")
    rows = scans.strings(spark, scans.files(spark, f"file://{tmp_path}"), required=["code"])
    assert sorted((r.code, r.name, r.source_file) for r in rows.collect()) == [("", "b", "MCA_25_C2_x.csv"), ("007", "", "MCA_25_C2_x.csv")]
    assert scans.missing_columns(spark, f"file://{tmp_path}/MCA_25_C2_x.csv", ["code", "zip"]) == ["zip"]
    name = scans.named(rows, F.col("source_file")).first()
    assert (name.family, name.year, name.round, name.file_error) == ("MCA", 2025, 2, None)
    (tmp_path / "none").mkdir()
    for call in (lambda: scans.files(spark, f"file://{tmp_path}/none"), lambda: scans.strings(spark, f"file://{tmp_path}/MCA_25_C2_x.csv", required=["zip"])):
        try:
            call()
            raise AssertionError
        except (FileNotFoundError, ValueError):
            pass
