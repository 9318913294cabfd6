"""Queries of canonical names, contacts, trend documents, seat tables, selections, file names and page audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_load import SEAT_CELLS, seat_cells
from .catalog_search import COURSE, FACT, course, fact, programs
from .operators import gates, naming, search
from .registered import query, read
from .sources import scans, sinks

# Line items as delivered rows whose institute names vary by year and row.
NAMED = """WITH d AS (SELECT CAST(l_suppkey AS VARCHAR) AS code, trim(concat(CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat('Institute ', l_suppkey, ' ') END,
  CASE l_quantity % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END)) AS name, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
e AS (SELECT code, name, year, count(*) AS n FROM d WHERE name <> '' GROUP BY ALL),
c AS (SELECT code, name, year FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, n DESC, name) AS k FROM e) WHERE k = 1) """


def delivered_names(spark, sf_dir):
    k = F.col
    start = F.when(k("l_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("Institute "), "l_suppkey", F.lit(" ")))
    end = F.when(k("l_quantity") % 3 == 0, "A").when(k("l_quantity") % 3 == 1, "B").otherwise("")
    return read(spark, sf_dir, "lineitem").select(
        k("l_suppkey").cast("string").alias("institution_code"), F.concat(start, end).alias("institution_name"), F.year("l_shipdate").alias("year")
    )


def stored_institutes(spark, sf_dir):
    k = F.col
    return read(spark, sf_dir, "supplier").select(
        k("s_suppkey").cast("string").alias("institution_code"), k("s_name").alias("institution_name"), F.concat(F.lit("N"), "s_nationkey").alias("city"),
        F.lit(None).cast("string").alias("website"),
    )


@query(NAMED + """, s AS (SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name, concat('N', s_nationkey) AS city FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT coalesce(s.code, c.code) AS institution_code, coalesce(c.name, s_name) AS institution_name, city FROM s FULL JOIN c ON s.code = c.code""")
def q110_canonical_names(spark, sf_dir):
    """Stored institutes renamed by the deliveries, and those that were not stored."""
    stored = stored_institutes(spark, sf_dir).where("institution_code % 3 <> 0").drop("website")
    return naming.with_names(stored, naming.canonical_names(delivered_names(spark, sf_dir))["names"])


@query(NAMED + "SELECT code AS institution_code, name AS institution_name, CAST(sum(n) AS BIGINT) AS n FROM e WHERE (code, name) NOT IN (SELECT (code, name) FROM c) GROUP BY ALL")
def q111_name_variants(spark, sf_dir):
    return naming.canonical_names(delivered_names(spark, sf_dir))["variants"]


# A list of contacts: two codes a row; of one in seven the name has nothing in common with the stored one.
LISTED = """WITH l AS (SELECT s_suppkey AS idx, [CAST(s_suppkey AS VARCHAR), CAST(s_suppkey + 2 AS VARCHAR)] AS codes, CASE WHEN s_suppkey % 7 = 0 THEN 'xyz' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 9 < 4 THEN 'P' ELSE concat('C', s_suppkey % 4) END AS city, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE concat('site', s_suppkey) END AS site FROM supplier),
x AS (SELECT unnest(codes) AS code, idx, name, city, site FROM l),
g AS (SELECT code, count(DISTINCT city) > 1 AS conflict, arg_min(struct_pack(name, city, site), (site IS NULL, idx)) AS b FROM x GROUP BY code),
j AS (SELECT g.code, b, s_suppkey, CASE WHEN conflict THEN 'CITY_CONFLICT' WHEN s_suppkey IS NULL THEN 'CODE_NOT_IN_DB' WHEN b.name = 'xyz' THEN 'NAME_MISMATCH' END AS reason FROM g LEFT JOIN supplier ON code = CAST(s_suppkey AS VARCHAR)) """


def contact_list(spark, sf_dir):
    k = F.col("s_suppkey")
    site = F.when(k % 3 == 0, " Unknown ").when(k % 3 == 1, "").otherwise(F.concat(F.lit(" site"), k))
    return read(spark, sf_dir, "supplier").select(
        k.alias("idx"), F.concat_ws(", ", k, k + 2).alias("codes"), F.when(k % 7 == 0, "xyz").otherwise(F.lower("s_name")).alias("name"),
        F.when(k % 9 < 4, "P").otherwise(F.concat(F.lit("C"), k % 4)).alias("city"), site.alias("website"),
    )


@query(LISTED + """SELECT CAST(supplier.s_suppkey AS VARCHAR) AS institution_code, s_name AS institution_name, CASE WHEN j.code IS NULL THEN concat('N', s_nationkey) ELSE b.city END AS city, CASE WHEN j.code IS NOT NULL THEN b.site END AS website
FROM supplier LEFT JOIN j ON j.code = CAST(supplier.s_suppkey AS VARCHAR) AND reason IS NULL""")
def q112_contacts(spark, sf_dir):
    return naming.contacts(stored_institutes(spark, sf_dir), contact_list(spark, sf_dir), "idx")["institutes"]


@query(LISTED + "SELECT code AS institution_code, reason FROM j WHERE reason IS NOT NULL")
def q113_quarantined_contacts(spark, sf_dir):
    return naming.contacts(stored_institutes(spark, sf_dir), contact_list(spark, sf_dir), "idx")["quarantined"].drop("detail")


TREND_KEYS = ["program_id", "institution_code", "base_category", "is_ladies", "section_code"]
POINTS = FACT + """, q AS (SELECT program_family, program_id, institution_code, base_category, is_ladies, section_code, year, round, round(min(percentile), 4) AS percentile, max(rank_number) AS rank
FROM f JOIN p USING (program_id) WHERE NOT (rank_number = 0 AND percentile = 0.0) GROUP BY ALL) """


def trend_points(spark, sf_dir):
    rows = fact(spark, sf_dir).join(programs(spark, sf_dir), "program_id")
    return search.closing_points(rows, ["program_family", "program_name", *TREND_KEYS])


@query(POINTS + """SELECT concat(program_family, ':', institution_code) AS name, count(*) AS n, count(DISTINCT (program_id, base_category, is_ladies, section_code)) AS series,
CAST(count(DISTINCT program_id) AS INTEGER) AS branches, string_agg(DISTINCT base_category, '+' ORDER BY base_category) AS categories, CAST(sum(rank) AS BIGINT) AS ranks, TRUE AS labelled FROM q GROUP BY program_family, institution_code""")
def q114_trend_documents(spark, sf_dir):
    """A document for each family and college, taken apart again."""
    docs = sinks.trends(trend_points(spark, sf_dir), ["program_family", "institution_code"], ["program_id", "base_category", "is_ladies", "section_code"], {"program_id": "program_name"}, ["base_category", "section_code"])
    form = "codes struct<program_id:map<string,string>,base_category:array<string>>, groups array<struct<program_id:bigint,points:array<struct<year:int,round:int,percentile:double,rank:int>>>>"
    d = docs.select("name", F.from_json("document", form).alias("d"))
    points = F.flatten(F.col("d.groups.points"))
    named = F.forall("d.groups", lambda g: F.map_contains_key(F.col("d.codes.program_id"), g["program_id"].cast("string")))
    return d.select(
        "name", F.size(points).cast("bigint").alias("n"), F.size("d.groups").cast("bigint").alias("series"), F.size("d.codes.program_id").alias("branches"),
        F.array_join("d.codes.base_category", "+").alias("categories"), F.aggregate(points, F.lit(0).cast("bigint"), lambda s, x: s + x["rank"]).alias("ranks"), named.alias("labelled"),
    )


@query(POINTS + "SELECT institution_code, base_category, round, string_agg(concat(year, ':', rank), ',' ORDER BY year) AS series FROM (SELECT institution_code, base_category, year, round, max(rank) AS rank FROM q GROUP BY ALL) GROUP BY ALL")
def q115_round_series(spark, sf_dir):
    points = search.closing_points(fact(spark, sf_dir).join(programs(spark, sf_dir), "program_id"), ["institution_code", "base_category"])
    got = search.round_series(points, ["institution_code", "base_category"], "rank")
    return got.withColumn("series", F.array_join(F.transform("series", lambda x: F.concat(x["year"].cast("string"), F.lit(":"), x["value"].cast("string"))), ","))


@query(FACT + """SELECT institution_code, min(percentile) FILTER (base_category IN ('R', 'A') AND section_code IN ('S1', 'S2')) AS low, max(percentile) FILTER (base_category IN ('R', 'A') AND section_code IN ('S1', 'S2')) AS high,
count(*) FILTER (base_category IN ('R', 'A') AND section_code IN ('S1', 'S2')) AS n FROM f GROUP BY 1""")
def q116_chosen_range(spark, sf_dir):
    rows = search.flagged(fact(spark, sf_dir), base_category=["R", "A"], section_code=["S1", "S2"], is_ladies=None)
    return search.chosen_range(rows, ["institution_code"], "percentile")


@query(COURSE + """SELECT institution_code, institution_name, max(cutoff_percentile) AS highest_cutoff, any_value(n) AS seats FROM m LEFT JOIN (SELECT o_custkey % 50 AS institution_code, count(*) AS n FROM orders WHERE o_custkey % 50 < 20 GROUP BY 1) USING (institution_code)
GROUP BY 1, 2 ORDER BY seats DESC NULLS LAST, institution_code""")
def q117_sorted_by_seats(spark, sf_dir):
    seats = read(spark, sf_dir, "orders").where("o_custkey % 50 < 20").groupBy((F.col("o_custkey") % 50).alias("institution_code")).agg(F.count("*").alias("seats"))
    rows = search.summary(course(spark, sf_dir)).join(seats, "institution_code", "left")
    return search.sorted_results(rows, "seats").select("institution_code", "institution_name", "highest_cutoff", "seats")


CATEGORIES = ["OPEN", "VJDT", "X", "Total"]


@query(SEAT_CELLS + """, v AS (SELECT institution_code, choice_code, allocation_type, category, arg_max(seats, o_orderkey) FILTER (gender = 'G' AND category <> 'Total') AS g, arg_max(seats, o_orderkey) FILTER (gender = 'L' AND category <> 'Total') AS l,
  arg_max(seats, o_orderkey) FILTER (gender = '' OR category = 'Total') AS t, CASE category WHEN 'OPEN' THEN 1 WHEN 'VJDT' THEN 2 WHEN 'X' THEN 3 WHEN 'Total' THEN 4 ELSE 5 END AS co
  FROM (SELECT * REPLACE (CAST(CAST(seats AS DOUBLE) AS INTEGER) AS seats) FROM c) WHERE institution_code <> '' GROUP BY ALL),
w AS (SELECT institution_code, choice_code, allocation_type, string_agg(concat(category, '/', coalesce(CAST(g AS VARCHAR), '-'), '/', coalesce(CAST(l AS VARCHAR), '-'), '/', coalesce(CAST(t AS VARCHAR), '-')), ' ' ORDER BY co, category) AS r FROM v GROUP BY ALL)
SELECT institution_code, choice_code, string_agg(concat(allocation_type, '=', r), '; ' ORDER BY CASE allocation_type WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, allocation_type) AS tables FROM w GROUP BY ALL""")
def q118_seat_tables(spark, sf_dir):
    got = sinks.seat_tables(seat_cells(spark, sf_dir), ["o_orderkey"], ["5-LOW", "1-URGENT"], CATEGORIES)
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    cells = lambda rows: F.array_join(F.transform(rows, lambda r: F.concat_ws("/", r["category"], text(r["G"]), text(r["L"]), text(r["total"]))), " ")
    return got.withColumn("tables", F.array_join(F.transform("tables", lambda t: F.concat_ws("=", t["allocation_type"], cells(t["rows"]))), "; "))


FAMILY_WORDS = ["bca", "MBA", "XMCAX", "notes"]


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN 'BCA' WHEN 1 THEN 'MBA' WHEN 2 THEN 'MCA' END AS family,
  CASE WHEN l_partkey % 3 < 2 THEN CAST(year(l_shipdate) + 10 AS INTEGER) END AS year, CASE WHEN l_orderkey % 3 < 2 THEN concat('C', l_linenumber) END AS round FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 3 = 1 THEN 'SEATS' ELSE 'CUTOFFS' END AS kind, family, year, round,
((family IS NOT NULL)::INT + (year IS NOT NULL)::INT + (round IS NOT NULL)::INT) / 3.0::DOUBLE AS confidence FROM n""")
def q119_identified_files(spark, sf_dir):
    k = F.col
    pick = lambda values, i: F.element_at(F.array(*values), (i + 1).cast("int"))
    year = F.year("l_shipdate") + 10
    years = [year.cast("string"), F.lpad((year % 100).cast("string"), 2, "0"), F.lit("123")]
    tails = [F.lit("_cutoffs.csv"), F.lit("_sm.csv"), F.lit("X.csv")]
    name = F.concat(pick(list(map(F.lit, FAMILY_WORDS)), k("l_suppkey") % 4), F.lit("_"), pick(years, k("l_partkey") % 3), F.lit("_c"), "l_linenumber", pick(tails, k("l_orderkey") % 3))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("_name"))
    return scans.identified(rows, k("_name")).drop("_name")


@query("""SELECT concat(l_returnflag, '.pdf') AS source_file, l_suppkey AS page, count(*) FILTER (l_partkey % 5 <> 0) AS records, count(*) FILTER (l_partkey % 5 = 0) AS errors,
coalesce(string_agg(DISTINCT l_linestatus, '+' ORDER BY l_linestatus) FILTER (l_partkey % 5 <> 0), '') AS methods FROM lineitem GROUP BY 1, 2""")
def q120_page_audit(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit(".pdf")).alias("source_file"), F.col("l_suppkey").alias("page"), F.col("l_linestatus").alias("method"), "l_partkey")
    return gates.page_audit(rows.where("l_partkey % 5 <> 0"), rows.where("l_partkey % 5 = 0"))
