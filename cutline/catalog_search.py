"""Queries of the interface: lookups, eligible rows, seat matrix, summaries, detail, search index, ranges and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registered import query, read
from .operators import search

FACT = """WITH f AS (SELECT l_suppkey AS institution_code, l_partkey AS program_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS round, l_returnflag AS base_category, l_linestatus = 'O' AS is_ladies,
  concat('S', l_orderkey % 4) AS section_code, l_linenumber AS stage_code, l_extendedprice / 1000 AS percentile, CAST(l_quantity AS INTEGER) AS rank_number FROM lineitem),
i AS (SELECT s_suppkey AS institution_code, s_name AS institution_name, CASE WHEN s_suppkey % 4 <> 0 THEN n_name END AS city, concat('site', s_suppkey) AS website FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT p_partkey AS program_id, p_brand AS program_family, p_name AS program_name FROM part),
x AS (SELECT i.*, program_family, program_name, year, round, base_category, is_ladies, section_code, stage_code, percentile AS cutoff_percentile, rank_number AS cutoff_rank, program_id FROM f JOIN i USING (institution_code) JOIN p USING (program_id) WHERE NOT (rank_number = 0 AND percentile = 0.0)) """


def fact(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("institution_code"), F.col("l_partkey").alias("program_id"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("round"), F.col("l_returnflag").alias("base_category"), (F.col("l_linestatus") == "O").alias("is_ladies"),
        F.concat(F.lit("S"), F.col("l_orderkey") % 4).alias("section_code"), F.col("l_linenumber").alias("stage_code"), (F.col("l_extendedprice") / 1000).alias("percentile"), F.col("l_quantity").cast("int").alias("rank_number"),
    )


def institutes(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("institution_code"), F.col("s_name").alias("institution_name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("n_name")).alias("city"), F.concat(F.lit("site"), "s_suppkey").alias("website"))


def programs(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("program_id"), F.col("p_brand").alias("program_family"), F.col("p_name").alias("program_name"))


FAMILY, CLEARED = "Brand#13", 40.0
COURSE = FACT + f", m AS (SELECT * FROM x WHERE program_family = '{FAMILY}' AND cutoff_percentile <= {CLEARED}) "


def course(spark, sf_dir):
    return search.course_rows(fact(spark, sf_dir), institutes(spark, sf_dir), programs(spark, sf_dir), CLEARED, FAMILY)


@query(FACT + "SELECT DISTINCT year FROM f ORDER BY year DESC")
def q70_lookup_years(spark, sf_dir):
    return search.lookup(fact(spark, sf_dir), "year", falling=True)


@query(FACT + "SELECT DISTINCT program_family FROM p ORDER BY program_family")
def q71_lookup_families(spark, sf_dir):
    return search.lookup(programs(spark, sf_dir), "program_family")


@query(FACT + "SELECT DISTINCT base_category FROM f ORDER BY base_category")
def q72_lookup_categories(spark, sf_dir):
    return search.lookup(fact(spark, sf_dir), "base_category")


ELIGIBLE = "SELECT institution_name, institution_code, program_name, year, round, stage_code, section_code, cutoff_percentile, cutoff_rank FROM x WHERE cutoff_percentile <= {} AND base_category = '{}' AND program_family = '{}' AND NOT is_ladies"


@query(FACT + ELIGIBLE.format(45.0, "R", "Brand#23") + " AND year = 1996 AND round = 2")
def q73_eligible_in_round(spark, sf_dir):
    return search.eligible(fact(spark, sf_dir), institutes(spark, sf_dir), programs(spark, sf_dir), 45.0, "R", "Brand#23", year=1996, round_no=2)


@query(FACT + ELIGIBLE.format(45.0, "R", "Brand#23"))
def q74_eligible(spark, sf_dir):
    return search.eligible(fact(spark, sf_dir), institutes(spark, sf_dir), programs(spark, sf_dir), 45.0, "R", "Brand#23")


@query(COURSE + "SELECT institution_code, city, year, round, cutoff_percentile, cutoff_rank FROM m WHERE contains(lower(coalesce(city, '')), 'n_1')")
def q75_course_in_city(spark, sf_dir):
    return search.in_city(course(spark, sf_dir), " N_1 ").select("institution_code", "city", "year", "round", "cutoff_percentile", "cutoff_rank")


SUMMARY = "SELECT institution_code, any_value(institution_name) AS institution_name, any_value(city) AS city, any_value(website) AS website, max(cutoff_percentile) AS highest_cutoff, count(DISTINCT year) AS years_on_record, count(*) AS matching_rows FROM m GROUP BY institution_code"


@query(COURSE + SUMMARY)
def q76_summary(spark, sf_dir):
    return search.summary(course(spark, sf_dir))


@query(COURSE + SUMMARY.replace("FROM m", "FROM m WHERE FALSE"))
def q77_empty_summary(spark, sf_dir):
    return search.summary(course(spark, sf_dir).where("false"))


@query(COURSE + "SELECT year, round, max(cutoff_percentile) AS highest_cutoff FROM m WHERE institution_code = 7 GROUP BY ALL ORDER BY year, round")
def q78_detail(spark, sf_dir):
    return search.detail(course(spark, sf_dir), 7)


SEATS = """WITH s AS (SELECT o_custkey % 50 AS institution_code, o_orderstatus AS program_family, o_orderpriority AS allocation_lane, CAST(o_orderkey % 7 AS VARCHAR) AS base_category, o_orderkey % 7 = 0 AS is_total, o_orderkey % 3 = 0 AS is_ladies,
  o_orderkey % 60 AS seats, CAST(year(o_orderdate) AS INTEGER) AS capture_year FROM orders) """


def seat_rows(spark, sf_dir):
    k = F.col
    return read(spark, sf_dir, "orders").select(
        (k("o_custkey") % 50).alias("institution_code"), k("o_orderstatus").alias("program_family"), k("o_orderpriority").alias("allocation_lane"), (k("o_orderkey") % 7).cast("string").alias("base_category"), (k("o_orderkey") % 7 == 0).alias("is_total"), (k("o_orderkey") % 3 == 0).alias("is_ladies"),
        (k("o_orderkey") % 60).alias("seats"), F.year("o_orderdate").alias("capture_year"),
    )


@query(SEATS + """SELECT allocation_lane, base_category, is_total, is_ladies, seats, capture_year FROM s WHERE institution_code = 7 AND program_family = 'O'
AND capture_year = (SELECT max(capture_year) FROM s WHERE institution_code = 7 AND program_family = 'O')""")
def q79_seat_matrix(spark, sf_dir):
    return search.seat_matrix(seat_rows(spark, sf_dir), 7, "O")


@query(FACT + SEATS.replace("WITH", ",") + """, g AS (SELECT institution_code, base_category AS fam, section_code AS cat, CAST(stage_code AS VARCHAR) AS sec, is_ladies, year, percentile, rank_number FROM f WHERE NOT (rank_number = 0 AND percentile = 0.0)),
r AS (SELECT *, row_number() OVER (PARTITION BY institution_code, fam, year ORDER BY percentile, rank_number DESC) AS n FROM g WHERE cat = 'S1' AND NOT is_ladies),
y AS (SELECT institution_code, fam, year, min(percentile) AS low, max(percentile) AS high, any_value(rank_number) FILTER (n = 1) AS rank, row_number() OVER (PARTITION BY institution_code, fam ORDER BY year DESC) AS back FROM r GROUP BY institution_code, fam, year),
h AS (SELECT institution_code, fam, string_agg(concat(year, ' ', rank), ',' ORDER BY year) AS history, min(low) AS low, max(high) AS high, any_value(rank) FILTER (back = 1) AS cutoff, any_value(low) FILTER (back = 1) AS percentile FROM y WHERE back <= 4 GROUP BY ALL),
yr AS (SELECT institution_code, fam, string_agg(DISTINCT year, ',' ORDER BY year) AS years FROM g GROUP BY ALL), o AS (SELECT institution_code, fam, is_ladies, cat, string_agg(DISTINCT sec, '+' ORDER BY sec) AS secs FROM g GROUP BY ALL),
c AS (SELECT institution_code, fam, coalesce(string_agg(concat(cat, ':', secs), ',' ORDER BY cat) FILTER (NOT is_ladies), '') AS general, coalesce(string_agg(concat(cat, ':', secs), ',' ORDER BY cat) FILTER (is_ladies), '') AS ladies FROM o GROUP BY ALL),
z AS (SELECT * REPLACE (['A', 'N', 'R'][ascii(program_family) % 3 + 1] AS program_family) FROM s),
t AS (SELECT institution_code, program_family AS fam, CAST(sum(seats) AS BIGINT) AS seats FROM z WHERE is_total AND capture_year = (SELECT max(capture_year) FROM z w WHERE w.institution_code = z.institution_code AND w.program_family = z.program_family) GROUP BY ALL)
SELECT institution_code, institution_name, fam AS program_family, cutoff, percentile, history, low, high, years, general, ladies, seats FROM h JOIN yr USING (institution_code, fam) JOIN c USING (institution_code, fam) LEFT JOIN t USING (institution_code, fam) JOIN i USING (institution_code)""")
def q80_search_index(spark, sf_dir):
    f = fact(spark, sf_dir).withColumns({"program_family": F.col("base_category"), "base_category": F.col("section_code"), "section_code": F.col("stage_code").cast("string")})
    seats = seat_rows(spark, sf_dir).withColumn("program_family", F.element_at(F.array(*map(F.lit, "ANR")), (F.ascii("program_family") % 3 + 1).cast("int")))
    got = search.search_index(f, seats, institutes(spark, sf_dir), category="S1")

    def listed(options):
        return F.array_join(F.transform(options, lambda o: F.concat(o["category"], F.lit(":"), F.array_join(o["sections"], "+"))), ",")

    history = F.array_join(F.transform("history", lambda h: F.concat(h["year"].cast("string"), F.lit(" "), h["rank"].cast("string"))), ",")
    return got.select(
        "institution_code", "institution_name", "program_family", "cutoff", "percentile", "seats", history.alias("history"), F.array_min("history.low").alias("low"), F.array_max("history.high").alias("high"),
        F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), listed(F.col("general")).alias("general"), listed(F.col("ladies")).alias("ladies"),
    )


@query(FACT + """, y AS (SELECT institution_code, year, min(percentile) AS low, max(percentile) AS high FROM f GROUP BY ALL)
SELECT institution_code, max(high) AS highest, arg_max(year, (high, -year)) AS highest_year, min(low) AS lowest, arg_min(year, (low, year)) AS lowest_year FROM y GROUP BY 1""")
def q81_year_extremes(spark, sf_dir):
    y = fact(spark, sf_dir).groupBy("institution_code", "year").agg(F.min("percentile").alias("low"), F.max("percentile").alias("high"))
    return search.year_extremes(y, ["institution_code"], "year", "low", "high")


@query(FACT + "SELECT institution_code, year, round, min(percentile) AS closing FROM f WHERE year = (SELECT max(year) FROM f g WHERE g.institution_code = f.institution_code) GROUP BY ALL")
def q82_latest_rounds(spark, sf_dir):
    return search.latest_rounds(fact(spark, sf_dir), ["institution_code"], "percentile").select("institution_code", "year", "round", "closing")


@query(FACT + "SELECT institution_code, count(*) FILTER (percentile BETWEEN 35 AND 45) AS inside, count(*) FILTER (percentile BETWEEN 35 AND 45 AND base_category IN ('R', 'A')) AS selected, count(*) < 600 AS limited FROM f GROUP BY 1")
def q83_selection(spark, sf_dir):
    return search.selection(fact(spark, sf_dir), 35, 45, "percentile", F.col("base_category").isin("R", "A"), 600, ["institution_code"])


@query(FACT + "SELECT count(*) AS total, count(city) AS with_city, count(website) AS with_website FROM i")
def q84_coverage(spark, sf_dir):
    return search.coverage(institutes(spark, sf_dir), ["city", "website"])
