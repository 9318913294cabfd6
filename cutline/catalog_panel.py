"""Queries of the gates as a whole, seat differences, college payloads, raw rows, the detail panel and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registered import query, read
from .catalog_load import CELLS, CUTOFF_KEY, KNOWN, PROGRAMS, SEAT_CELLS, LANES, STATUS, cells, seat_cells
from .catalog_search import COURSE, FACT, SEATS, course, fact, programs, seat_rows
from .functions import vocabulary
from .operators import gates, search
from .sources import sinks
from .sources.workspace import kept

#: The order of rows in a file; orders and numbers repeat.
ROW = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)"
# Delivered cells with a row number, filled within each file.
BLOCK = ["institution_name", "section", "stage"]
FILLED = CELLS[: CELLS.index("k AS (SELECT *")].rstrip().rstrip(",").replace("SELECT l_orderkey, l_linenumber,", f"SELECT {ROW} AS row,", 1) + """,
w AS (SELECT * REPLACE (CASE WHEN trim(institution_name) = '' THEN last_value(nullif(trim(institution_name), '') IGNORE NULLS) OVER o ELSE institution_name END AS institution_name,
  CASE WHEN trim(section) = '' THEN last_value(nullif(trim(section), '') IGNORE NULLS) OVER o ELSE section END AS section, CASE WHEN trim(stage) = '' THEN last_value(nullif(trim(stage), '') IGNORE NULLS) OVER o ELSE stage END AS stage),
  (trim(institution_name) = '')::INT AS b1, (trim(section) = '')::INT AS b2, (trim(stage) = '')::INT AS b3 FROM c WINDOW o AS (PARTITION BY source_file ORDER BY row)),
k AS (SELECT *, (trim(institution_code) = '' AND trim(coalesce(institution_name, '')) = '') OR upper(trim(category)) = 'GOVERNMENT' AS anomaly, CASE category WHEN 'LOPENH' THEN 'OPEN' WHEN 'GZZZH' THEN 'ZZZ' END AS base,
  CASE stage WHEN 'Stage I' THEN 'Stage-I' WHEN 'Stage-VII' THEN 'Stage-VII' END AS stage_code, CASE section WHEN 'State Level' THEN 'SL' END AS section_code, TRY_CAST(percentage AS DOUBLE) AS pct,
  b1 * (institution_name IS NOT NULL)::INT + b2 * (section IS NOT NULL)::INT + b3 * (stage IS NOT NULL)::INT AS filled FROM w),
d AS (SELECT source_file, sum(n) AS duplicates FROM (SELECT source_file, count(*) AS n FROM w GROUP BY source_file, institution_code, program_name, category, section, stage, rank_number, percentage) WHERE n > 1 GROUP BY 1),
e AS (SELECT source_file, concat('FIRST_ROW_BLANK: ', concat_ws(', ', CASE WHEN b1 = 1 THEN 'institution_name' END, CASE WHEN b2 = 1 THEN 'section' END, CASE WHEN b3 = 1 THEN 'stage' END)) AS error FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY row) AS n FROM w) WHERE n = 1 AND b1 + b2 + b3 > 0),
u AS (SELECT DISTINCT 'category' AS kind, category AS value FROM k WHERE NOT anomaly AND (base IS NULL OR base <> 'OPEN') UNION ALL SELECT DISTINCT 'stage', stage FROM k WHERE NOT anomaly AND stage_code IS NULL
  UNION ALL SELECT DISTINCT 'section', section FROM k WHERE NOT anomaly AND section <> '' AND section_code IS NULL UNION ALL SELECT DISTINCT 'program', program_name FROM k WHERE NOT anomaly AND program_name = 'Program 19') """


def gate(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = cells(spark, sf_dir, [F.struct(*order).alias("row")]).drop("l_orderkey", "l_linenumber")
    return gates.cutoff_gate(rows, "row", KNOWN, PROGRAMS, BLOCK)


@query(FILLED + """SELECT k.source_file, count(*) AS n_rows, count(*) FILTER (anomaly) AS anomaly, count(*) FILTER (NOT anomaly AND (base IS NULL OR base <> 'OPEN')) AS bad_category, count(*) FILTER (NOT anomaly AND stage_code IS NULL) AS bad_stage,
count(*) FILTER (NOT anomaly AND section <> '' AND section_code IS NULL) AS bad_section, count(*) FILTER (NOT anomaly AND program_name = 'Program 19') AS bad_program, count(*) FILTER (NOT anomaly AND pct IS NULL) AS bad_percentage,
CAST(sum(filled) AS BIGINT) AS filled, CAST(coalesce(any_value(duplicates), 0) AS BIGINT) AS duplicates FROM k LEFT JOIN d ON d.source_file = k.source_file GROUP BY k.source_file""")
def q99_gate_report(spark, sf_dir):
    return gate(spark, sf_dir)["report"]


@query(FILLED + "SELECT source_file, error, (SELECT count(*) FROM u) + (SELECT count(*) FROM e) AS total FROM e")
def q100_gate_errors(spark, sf_dir):
    """File errors, each with the gate's number of issues."""
    got = gate(spark, sf_dir)
    return got["errors"].withColumn("total", F.lit(got["total"].first()[0]))


@query(CELLS + f""", s AS (SELECT *, coalesce({STATUS}, CASE WHEN program_name IN ('Program 3', 'Program 4') THEN 'FOREIGN_KEY_FAILED' END) AS st FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY st IS NULL, institution_code, program_name, base, section_code, stage_code, rank_number, pct ORDER BY l_orderkey, l_linenumber) AS n FROM s),
old AS (SELECT DISTINCT institution_code, program_name, base, section_code, stage_code, rank_number, pct FROM s WHERE {STATUS} IS NULL AND l_orderkey % 10 = 0)
SELECT coalesce(st, CASE WHEN n > 1 OR old.institution_code IS NOT NULL THEN 'DUPLICATE_UNIQUE_KEY' ELSE 'inserted' END) AS status, count(*) AS n FROM r LEFT JOIN old USING (institution_code, program_name, base, section_code, stage_code, rank_number, pct) GROUP BY 1""")
def q101_second_load(spark, sf_dir):
    """A load whose target holds a tenth of the orders, and whose programs aren't all known."""
    rows = cells(spark, sf_dir)
    target = gates.cutoff_checks(rows.where("l_orderkey % 10 = 0")).where("not anomaly and base is not null and not bad_stage and section_code is not null and not bad_percentage")
    known = spark.createDataFrame([(f"Program {i}",) for i in range(20) if i not in (3, 4)], "program_name string")
    got = gates.cutoff_status(rows, kept(target.select(*CUTOFF_KEY), "target"), CUTOFF_KEY, [F.asc("l_orderkey"), F.asc("l_linenumber")], {"program_name": known})
    return got.groupBy("status").agg(F.count("*").alias("n"))


@query(SEAT_CELLS + """, n AS (SELECT o_orderkey, substr(choice_code, 1, 5) AS code, choice_code, CASE allocation_type WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' WHEN '3-MEDIUM' THEN 'M' WHEN '5-LOW' THEN 'L' ELSE allocation_type END AS lane, category, gender FROM c)
SELECT CASE WHEN EXISTS (SELECT 1 FROM n m WHERE m.o_orderkey % 4 = 0 AND m.code = n.code AND m.choice_code = n.choice_code AND m.lane = n.lane AND m.category = n.category AND m.gender = n.gender) THEN 'present' ELSE 'new' END AS change, lane, count(*) AS n FROM n GROUP BY 1, 2""")
def q102_seat_diff(spark, sf_dir):
    """Seat rows against a capture that holds a quarter of them under canonical codes."""
    rows = seat_cells(spark, sf_dir)
    code = vocabulary.institution_code(F.col("institution_code"), F.col("choice_code"))["code"].alias("institution_code")
    lane = F.coalesce(F.try_element_at(F.create_map(*(F.lit(t) for kv in LANES.items() for t in kv)), "allocation_type"), "allocation_type")
    stored = rows.where("o_orderkey % 4 = 0").select(code, "choice_code", lane.alias("allocation_lane"), F.col("category").alias("raw_category"), F.col("gender").alias("raw_gender"), F.lit(2024).alias("capture_year"), F.lit("BCA").alias("program_family"))
    got = gates.seat_diff(rows, stored, LANES, 2024, "BCA")
    return got.groupBy("change", F.col("allocation_lane").alias("lane")).agg(F.count("*").alias("n"))


PAYLOADS = """WITH p AS (SELECT l_returnflag AS course, CAST(year(l_shipdate) AS INTEGER) AS yr, l_suppkey AS college, l_partkey AS branch, l_linenumber AS section, CAST(round(l_extendedprice * 100) AS BIGINT) AS pct FROM lineitem) """


def payload_rows(spark, sf_dir):
    k = F.col
    return read(spark, sf_dir, "lineitem").select(k("l_returnflag").alias("course"), F.year("l_shipdate").alias("yr"), k("l_suppkey").alias("college"), k("l_partkey").alias("branch"), k("l_linenumber").alias("section"), F.round(k("l_extendedprice") * 100).cast("bigint").alias("pct"))


@query(PAYLOADS + """SELECT concat(course, ':', yr, ':', college) AS name, count(*) AS n, CAST(count(DISTINCT section) AS INTEGER) AS sections, arg_min(branch, (section, branch, pct)) AS first_branch, arg_max(pct, (section, branch, pct)) AS last_pct, TRUE AS sized FROM p GROUP BY course, yr, college""")
def q103_college_year_payloads(spark, sf_dir):
    """A document for each course, year and college with its rows in order, taken apart again."""
    docs = sinks.college_payloads(payload_rows(spark, sf_dir), ["course", "yr", "college"], ["section"], ["section", "branch", "pct"])
    d = docs.select("name", (F.octet_length("document") == F.col("bytes")).alias("sized"), F.from_json("document", "codes struct<section:array<int>>, rows array<struct<branch:bigint,section:int,pct:bigint>>").alias("d"))
    return d.select("name", F.size("d.rows").cast("bigint").alias("n"), F.size("d.codes.section").alias("sections"), F.col("d.rows")[0]["branch"].alias("first_branch"), F.element_at("d.rows", -1)["pct"].alias("last_pct"), "sized")


@query(PAYLOADS + "SELECT concat(course, ':', college) AS name, count(*) AS n, CAST(count(DISTINCT yr) AS INTEGER) AS years FROM p GROUP BY course, college")
def q104_college_payloads(spark, sf_dir):
    docs = sinks.college_payloads(payload_rows(spark, sf_dir), ["course", "college"], ["yr"], ["yr", "section", "branch", "pct"])
    d = docs.select("name", F.from_json("document", "codes struct<yr:array<int>>, rows array<struct<branch:bigint>>").alias("d"))
    return d.select("name", F.size("d.rows").cast("bigint").alias("n"), F.size("d.codes.yr").alias("years"))


RAW_ORDER = ["year", "round", "institution_code", "program_id", "base_category", "is_ladies", "section_code", "stage_code", "percentile", "rank_number"]


@query(FACT + f"SELECT {', '.join(RAW_ORDER).replace('percentile', 'round(percentile, 7) AS percentile')} FROM f JOIN p USING (program_id) WHERE program_family = 'Brand#13' ORDER BY {', '.join(RAW_ORDER)}")
def q105_raw_rows(spark, sf_dir):
    return search.raw_rows(fact(spark, sf_dir), programs(spark, sf_dir), "Brand#13", RAW_ORDER).select(*RAW_ORDER)


def panel(spark, sf_dir):
    return search.detail_panel(course(spark, sf_dir), seat_rows(spark, sf_dir), 7, "O", "N")


@query(COURSE + "SELECT concat(year, ' R', round) AS year_round, max(cutoff_percentile) AS highest_cutoff, year, round FROM m WHERE institution_code = 7 AND base_category = 'N' AND NOT is_ladies GROUP BY year, round ORDER BY year, round")
def q106_detail_trend(spark, sf_dir):
    return panel(spark, sf_dir)["trend"]


@query(COURSE + "SELECT year, round, stage_code, section_code, cutoff_percentile, cutoff_rank FROM m WHERE institution_code = 7 AND base_category = 'N' AND NOT is_ladies ORDER BY year DESC, round DESC, stage_code, section_code, cutoff_percentile, cutoff_rank")
def q107_detail_table(spark, sf_dir):
    return panel(spark, sf_dir)["table"]


LATEST = "FROM s WHERE institution_code = 7 AND program_family = 'O' AND capture_year = (SELECT max(capture_year) FROM s WHERE institution_code = 7 AND program_family = 'O')"


@query(SEATS + f"SELECT TRUE AS is_total, allocation_lane, CAST(NULL AS VARCHAR) AS base_category, CAST(NULL AS BOOLEAN) AS is_ladies, seats {LATEST} AND is_total UNION ALL SELECT FALSE, allocation_lane, base_category, is_ladies, seats {LATEST} AND NOT is_total")
def q108_detail_seats(spark, sf_dir):
    got = panel(spark, sf_dir)
    lanes = got["lanes"].select(F.lit(True).alias("is_total"), "allocation_lane", F.lit(None).cast("string").alias("base_category"), F.lit(None).cast("boolean").alias("is_ladies"), "seats")
    return lanes.unionByName(got["seats"].withColumn("is_total", F.lit(False)))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_suppkey % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE k WHEN 0 THEN 'OHU_TO_HU' WHEN 1 THEN 'HU' WHEN 2 THEN 'SL' ELSE NULL END AS section, CASE WHEN k = 3 THEN NULL ELSE CAST(l_partkey AS DOUBLE) END AS seats, lpad(CAST(l_suppkey % 900 + 100 AS VARCHAR), 5, '0') AS institute,
CASE WHEN l_linenumber % 2 = 0 THEN -(l_partkey + 0.5)::DOUBLE END AS second, concat('branch_', l_suppkey, '_2') AS name, concat('Stage-I|', l_partkey, ';stage II|', l_suppkey) AS stages FROM t""")
def q109_text_rules(spark, sf_dir):
    """Lines made of each row's values, read back by the text rules."""
    k, text = F.col, lambda c: F.col(c).cast("string")
    heading = F.element_at(F.array(*map(F.lit, ["x  Other Than HOME University Seats allotted to Home University Candidates .", " home university seats  Allotted to Home University candidates", "State Level (all)", "Stage"])), (k("l_suppkey") % 4 + 1).cast("int"))
    seats = F.element_at(F.array(*(F.concat(F.lit(a), text("l_partkey"), F.lit(b)) for a, b in (("EWS (x) Seats: ", " y"), ("ews (X) seats", ""), ("a EWS (x) Seats :  ", "."), ("EWS x Seats: ", "")))), (k("l_suppkey") % 4 + 1).cast("int"))
    row = F.array(F.lit("a b"), F.lit(" 12 "), F.lit(None), F.when(k("l_linenumber") % 2 == 0, F.concat(F.lit("-"), text("l_partkey"), F.lit(".5"))).otherwise("7x"))
    page = F.array(F.lit("intro"), F.concat((k("l_suppkey") % 900 + 100).cast("string"), F.lit(" - Some College ")), F.lit("99999 - Another"))
    label = F.concat(F.lit(" Branch #"), text("l_suppkey"))
    stages = vocabulary.stage_parts(F.concat(F.lit("Stage-I "), text("l_partkey"), F.lit(" stage II "), text("l_suppkey")))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", vocabulary.detected_section(heading).alias("section"), vocabulary.labelled_number(seats, "EWS (x) Seats").alias("seats"), vocabulary.page_headings(page)["institute"].alias("institute"),
        vocabulary.row_numbers(row, 2)[1].alias("second"), vocabulary.slugs(F.array(label, F.lit("x"), label))[2].alias("name"), F.array_join(F.transform(stages, lambda p: F.concat(p["stage"], F.lit("|"), p["rest"])), ";").alias("stages"),
    )
