"""Queries of the library on the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import fields
from .operators import relational as op
from .registered import ORACLES, QUERIES, query, read

FLAGSHIP = "q01_closing_cutoff"

CUT = """WITH cut AS (SELECT l_suppkey AS inst, p_brand AS family, l_partkey AS prog, CAST(year(l_shipdate) AS INTEGER) AS yr,
  CAST(quarter(l_shipdate) AS INTEGER) AS rnd, l_returnflag AS cat, l_linestatus = 'O' AS ladies, l_linenumber AS stage,
  l_extendedprice AS pct, CAST(l_quantity AS INTEGER) AS rnk FROM lineitem JOIN part ON l_partkey = p_partkey) """
SEATS = """WITH seats AS (SELECT o_custkey AS inst, o_orderpriority AS lane, CAST(year(o_orderdate) AS INTEGER) AS capture_year,
  CAST(floor(o_totalprice) AS BIGINT) AS seats, o_orderkey AS id FROM orders) """
LINE = "WITH li AS (SELECT *, l_partkey % 97 = 0 AS bad, l_suppkey % 13 = 0 AS odd FROM lineitem) "


def cut(spark, sf_dir, family: bool = False) -> DataFrame:
    """Line items as cutoff rows; the family comes from another table, which is joined only where it is asked for."""
    rows = read(spark, sf_dir, "lineitem")
    if family:
        rows = rows.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_suppkey").alias("inst"), *([F.col("p_brand").alias("family")] if family else []), F.col("l_partkey").alias("prog"), F.year("l_shipdate").alias("yr"), F.quarter("l_shipdate").alias("rnd"),
        F.col("l_returnflag").alias("cat"), (F.col("l_linestatus") == "O").alias("ladies"), F.col("l_linenumber").alias("stage"), F.col("l_extendedprice").alias("pct"), F.col("l_quantity").cast("int").alias("rnk"),
    )


def seats(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("inst"), F.col("o_orderpriority").alias("lane"), F.year("o_orderdate").alias("capture_year"), F.floor("o_totalprice").alias("seats"), F.col("o_orderkey").alias("id"))


@query(CUT + "SELECT inst, cat, ladies, yr, rnd, min(pct) AS closing, max(rnk) AS worst_rank FROM cut WHERE NOT (rnk = 0 AND pct = 0.0) GROUP BY ALL")
def q01_closing_cutoff(spark, sf_dir):
    rows = cut(spark, sf_dir).where(fields.no_artifact(F.col("rnk"), F.col("pct")))
    return rows.groupBy("inst", "cat", "ladies", "yr", "rnd").agg(F.min("pct").alias("closing"), F.max("rnk").alias("worst_rank"))


@query(CUT + "SELECT inst, family, yr, min(pct) AS low, max(pct) AS high FROM cut WHERE cat = 'N' AND NOT ladies GROUP BY ALL")
def q02_yearly_low_high(spark, sf_dir):
    return cut(spark, sf_dir, family=True).where("cat = 'N' and not ladies").groupBy("inst", "family", "yr").agg(F.min("pct").alias("low"), F.max("pct").alias("high"))


Q03 = CUT + "SELECT inst, yr, pct, rnk, prog FROM (SELECT *, row_number() OVER (PARTITION BY inst, yr ORDER BY pct, rnk DESC, prog) AS n FROM cut) WHERE n = 1"


@query(Q03)
def q03_lowest_row_per_year(spark, sf_dir):
    return op.first_row(cut(spark, sf_dir), ["inst", "yr"], [F.asc("pct"), F.desc("rnk"), F.asc("prog")]).select("inst", "yr", "pct", "rnk", "prog")


@query(Q03)
def q04_lowest_row_min_by(spark, sf_dir):
    best = F.min(F.struct("pct", (-F.col("rnk")).alias("r"), "prog")).alias("b")
    return cut(spark, sf_dir).groupBy("inst", "yr").agg(best).select("inst", "yr", F.col("b.pct").alias("pct"), (-F.col("b.r")).alias("rnk"), F.col("b.prog").alias("prog"))


@query(CUT + "SELECT inst, family, prog, pct, rnk FROM cut WHERE pct <= 20000 AND cat = 'R' AND NOT ladies AND yr = 1998 AND NOT (rnk = 0 AND pct = 0.0)")
def q05_eligible(spark, sf_dir):
    rows = cut(spark, sf_dir, family=True).where((F.col("pct") <= 20000) & (F.col("cat") == "R") & ~F.col("ladies") & (F.col("yr") == 1998))
    return rows.where(fields.no_artifact(F.col("rnk"), F.col("pct"))).select("inst", "family", "prog", "pct", "rnk")


@query(CUT + "SELECT inst, max(pct) AS top, count(DISTINCT yr) AS years, count(*) AS n FROM cut GROUP BY inst")
def q07_summary(spark, sf_dir):
    return cut(spark, sf_dir).groupBy("inst").agg(F.max("pct").alias("top"), F.count_distinct("yr").alias("years"), F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(n_name), '1')")
def q08_city_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.where(F.lower("n_name").contains("1")).select("s_suppkey", "s_name", F.col("n_name").alias("city"))


@query(CUT + "SELECT inst, concat(yr, ' R', rnd) AS label, max(pct) AS top FROM cut GROUP BY ALL")
def q09_detail_trend(spark, sf_dir):
    return cut(spark, sf_dir).groupBy("inst", F.concat_ws(" R", "yr", "rnd").alias("label")).agg(F.max("pct").alias("top"))


@query(SEATS + "SELECT inst, lane, capture_year, seats, id FROM seats s WHERE capture_year = (SELECT max(capture_year) FROM seats t WHERE t.inst = s.inst)")
def q10_latest_snapshot(spark, sf_dir):
    return op.latest_snapshot(seats(spark, sf_dir), ["inst"], "capture_year").select("inst", "lane", "capture_year", "seats", "id")


@query(SEATS + "SELECT inst, CAST(sum(seats) AS BIGINT) AS seats FROM seats s WHERE capture_year = (SELECT max(capture_year) FROM seats t WHERE t.inst = s.inst) GROUP BY inst")
def q11_latest_snapshot_sum(spark, sf_dir):
    return op.latest_snapshot(seats(spark, sf_dir), ["inst"], "capture_year").groupBy("inst").agg(F.sum("seats").alias("seats"))


@query(CUT + "SELECT DISTINCT yr, cat FROM cut")
def q12_distinct_lookups(spark, sf_dir):
    return cut(spark, sf_dir).select("yr", "cat").distinct()


@query(CUT + "SELECT yr, count(*) AS n FROM cut WHERE pct BETWEEN 10000 AND 30000 GROUP BY yr")
def q13_range_and_count(spark, sf_dir):
    return cut(spark, sf_dir).where(F.col("pct").between(10000, 30000)).groupBy("yr").agg(F.count("*").alias("n"))


FILL = "WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS t FROM events), f AS (SELECT event_id, user_id, t, CASE WHEN t = '' THEN last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) ELSE t END AS filled FROM e) "


def filled(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("").alias("t"))
    return op.forward_fill(e.withColumn("filled", F.col("t")), ["filled"], ["user_id"], ["event_id"])


@query(FILL + "SELECT event_id, user_id, filled FROM f")
def q15_forward_fill(spark, sf_dir):
    return filled(spark, sf_dir).select("event_id", "user_id", "filled")


@query(FILL + "SELECT user_id, count(*) FILTER (t = '' AND filled IS NOT NULL) AS cells, count(*) FILTER (filled IS NULL) AS open FROM f GROUP BY user_id")
def q16_forward_fill_count(spark, sf_dir):
    return filled(spark, sf_dir).groupBy("user_id").agg(F.count_if((F.col("t") == "") & F.col("filled").isNotNull()).alias("cells"), F.count_if(F.col("filled").isNull()).alias("open"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicate FROM lineitem")
def q17_duplicate_flag(spark, sf_dir):
    return op.flag_duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "duplicate")


@query("SELECT l_returnflag AS flag, CAST(sum(n - 1) AS BIGINT) AS again FROM (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def q18_dup_after_first(spark, sf_dir):
    counts = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(F.col("n") - 1).alias("again"))


@query("""WITH p AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem), s AS (SELECT k, CAST(sum(q) AS BIGINT) AS parts FROM p GROUP BY k)
SELECT k, parts, parts + 1 AS total FROM s WHERE k % 97 = 0""")
def q19_reconcile_totals(spark, sf_dir):
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("bigint").alias("q"), F.lit(False).alias("is_total"))
    printed = parts.groupBy("k").agg(F.sum("q").alias("q")).select("k", (F.col("q") + F.when(F.col("k") % 97 == 0, 1).otherwise(0)).alias("q"), F.lit(True).alias("is_total"))
    return op.reconcile(parts.unionByName(printed), ["k"], F.col("is_total"), F.col("q"))


@query("""WITH c AS (SELECT o_orderkey AS id, upper(concat(CASE WHEN o_orderkey % 2 = 0 THEN 'g' ELSE 'l' END, 'open', CASE o_orderkey % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'o' ELSE '' END)) AS code FROM orders)
SELECT id, 'OPEN' AS base, id % 2 <> 0 AS ladies, CASE id % 3 WHEN 0 THEN 'HU' WHEN 1 THEN 'OHU' ELSE 'SL' END AS section FROM c""")
def q20_category_decompose(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.concat(F.when(k % 2 == 0, "g").otherwise("l"), F.lit("open"), F.when(k % 3 == 0, "h").when(k % 3 == 1, "o").otherwise(""))
    return read(spark, sf_dir, "orders").select(k.alias("id"), fields.decompose_category(code).alias("c")).select("id", "c.*")


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' ELSE 'Unknown' END AS code FROM orders")
def q21_canonical_maps(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fields.mapped(F.col("o_orderpriority"), {"1-URGENT": "U", "2-HIGH": "H"}, F.lit("Unknown")).alias("code"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS s FROM events)
SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(s, '[0-9]+') THEN s END AS INTEGER) AS i, TRY_CAST(s AS DOUBLE) AS d FROM x""")
def q22_safe_casts(spark, sf_dir):
    s = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", fields.safe_int(F.col("s")).alias("i"), fields.safe_double(F.col("s")).alias("d"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q23_json_project(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 5 THEN CAST(s_suppkey AS VARCHAR) ELSE lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS code FROM supplier")
def q24_pad_and_crosscheck(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", fields.zero_filled(F.col("s_suppkey").cast("string")).alias("code"))


STATUS = "CASE WHEN bad THEN 'QUARANTINED' WHEN odd THEN 'UNKNOWN_CATEGORY' WHEN l_quantity > 45 THEN 'BAD_PERCENTAGE' ELSE 'ok' END"


def with_status(spark, sf_dir):
    bad, odd = F.col("l_partkey") % 97 == 0, F.col("l_suppkey") % 13 == 0
    return read(spark, sf_dir, "lineitem").withColumn("status", F.when(bad, "QUARANTINED").when(odd, "UNKNOWN_CATEGORY").when(F.col("l_quantity") > 45, "BAD_PERCENTAGE").otherwise("ok"))


@query(LINE + f"SELECT l_orderkey, l_linenumber, l_partkey, {STATUS} AS status FROM li")
def q25_quarantine_status(spark, sf_dir):
    return with_status(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "status")


@query(LINE + f"SELECT l_returnflag AS file, count(*) AS n, count(*) FILTER ({STATUS} = 'QUARANTINED') AS anomalies, count(*) FILTER ({STATUS} = 'UNKNOWN_CATEGORY') AS bad_cat FROM li GROUP BY 1")
def q26_quality_counters(spark, sf_dir):
    s = F.col("status")
    return with_status(spark, sf_dir).groupBy(F.col("l_returnflag").alias("file")).agg(F.count("*").alias("n"), F.count_if(s == "QUARANTINED").alias("anomalies"), F.count_if(s == "UNKNOWN_CATEGORY").alias("bad_cat"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'duplicate' ELSE 'inserted' END AS status, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def q27_load_accounting(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    loaded = op.insert_new(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["o_orderkey"], [F.asc("o_custkey")])
    return loaded.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q28_fk_orphans(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000000, 'PATCHED' FROM customer WHERE c_custkey % 50 = 0")
def q29_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    patch = c.where("c_custkey % 5 = 0").unionByName(c.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000000)).withColumn("c_mktsegment", F.lit("PATCHED"))
    return op.upsert(c, patch, ["c_custkey"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'site' ELSE s_name END AS s_name FROM supplier")
def q30_update_matched(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    patch = s.where("s_suppkey % 2 = 0").withColumn("s_name", F.when(F.col("s_suppkey") % 4 != 0, "site"))
    return op.update_matched(s, patch, ["s_suppkey"], ["s_name"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0")
def q31_rollback_delete(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return op.rollback(o, o.where("o_orderkey % 7 = 0"), ["o_orderkey"])


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer)
SELECT k, v, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 3 = 0 THEN 'changed' ELSE 'exact' END AS change FROM c""")
def q32_snapshot_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    old = c.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 3 == 0, F.col("v") + 100).otherwise(F.col("v")))
    return op.snapshot_diff(c, old, ["k"], ["v"])


@query(CUT + "SELECT family, prog FROM (SELECT family, prog, row_number() OVER (PARTITION BY family ORDER BY yr DESC, n DESC, prog) AS k FROM (SELECT family, yr, prog, count(*) AS n FROM cut GROUP BY ALL)) WHERE k = 1")
def q33_mode_latest_year(spark, sf_dir):
    n = cut(spark, sf_dir, family=True).groupBy("family", "yr", "prog").agg(F.count("*").alias("n"))
    return op.first_row(n, ["family"], [F.desc("yr"), F.desc("n"), F.asc("prog")]).select("family", "prog")


@query(CUT + "SELECT inst, yr, low FROM (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY yr DESC) AS k FROM (SELECT inst, yr, min(pct) AS low FROM cut GROUP BY ALL)) WHERE k <= 4")
def q38_last4_history(spark, sf_dir):
    return op.last_rows(cut(spark, sf_dir).groupBy("inst", "yr").agg(F.min("pct").alias("low")), ["inst"], [F.desc("yr")], 4)


@query("SELECT l_returnflag AS cat, max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS l, max(CASE WHEN l_linestatus <> 'O' THEN l_quantity END) AS g FROM lineitem GROUP BY 1")
def q39_pivot_split(spark, sf_dir):
    ladies = F.col("l_linestatus") == "O"
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("cat")).agg(F.max(F.when(ladies, F.col("l_quantity"))).alias("l"), F.max(F.when(~ladies, F.col("l_quantity"))).alias("g"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 25")
def q41_topn_values(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(25)


@query("SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def q42_left_join(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").fillna(0, ["n"])


@query("(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) UNION ALL SELECT n_nationkey FROM nation")
def q43_set_ops(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).unionByName(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")))


@query(CUT + "SELECT inst, yr, low, low - lag(low) OVER (PARTITION BY inst ORDER BY yr) AS delta FROM (SELECT inst, yr, min(pct) AS low FROM cut GROUP BY ALL)")
def q47_yoy_delta(spark, sf_dir):
    low = cut(spark, sf_dir).groupBy("inst", "yr").agg(F.min("pct").alias("low"))
    return low.withColumn("delta", F.col("low") - F.lag("low").over(Window.partitionBy("inst").orderBy("yr")))


@query(CUT + "SELECT inst, yr, max(rnd) AS rnd, arg_max(low, rnd) AS final FROM (SELECT inst, yr, rnd, min(pct) AS low FROM cut GROUP BY ALL) GROUP BY ALL")
def q48_final_round(spark, sf_dir):
    low = cut(spark, sf_dir).groupBy("inst", "yr", "rnd").agg(F.min("pct").alias("low"))
    return low.groupBy("inst", "yr").agg(F.max("rnd").alias("rnd"), F.max_by("low", "rnd").alias("final"))


@query("SELECT p_partkey, 'size' AS field, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def q51_unpivot(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "field", "value")


@query(CUT + """SELECT s_name AS inst_name, p_name AS prog_name, family, yr, rnd, cat, ladies, pct, rnk FROM cut JOIN supplier ON inst = s_suppkey JOIN part ON prog = p_partkey
WHERE pct <= 20000 AND family = 'Brand#13' AND NOT (rnk = 0 AND pct = 0.0)""")
def q06_course_search(spark, sf_dir):
    rows = cut(spark, sf_dir, family=True).where((F.col("pct") <= 20000) & (F.col("family") == "Brand#13")).where(fields.no_artifact(F.col("rnk"), F.col("pct")))
    inst = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("inst"), F.col("s_name").alias("inst_name"))
    prog = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("prog"), F.col("p_name").alias("prog_name"))
    return rows.join(inst, "inst").join(prog, "prog").select("inst_name", "prog_name", "family", "yr", "rnd", "cat", "ladies", "pct", "rnk")


@query(CUT + """, d AS (SELECT inst, prog, yr, rnd, stage, (30000 - pct) / 1000 AS diff FROM cut)
SELECT inst, prog, yr, rnd, stage, CASE WHEN diff > 3 THEN 'high' WHEN diff >= 1 THEN 'good' WHEN diff >= 0 THEN 'fair' ELSE 'low' END AS badge,
CASE WHEN diff >= 1 THEN 'safe' WHEN diff >= -1 THEN 'borderline' ELSE 'reach' END AS band FROM d""")
def q14_chance_badge(spark, sf_dir):
    diff = (F.lit(30000) - F.col("pct")) / 1000
    return cut(spark, sf_dir).select("inst", "prog", "yr", "rnd", "stage", fields.chance_badge(diff).alias("badge"), fields.status_band(diff).alias("band"))


@query("""WITH l AS (SELECT s_suppkey AS idx, concat(s_suppkey, ', ', s_suppkey + 2) AS codes, s_nationkey % 2 AS city, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS site FROM supplier WHERE s_suppkey % 4 < 3),
x AS (SELECT trim(unnest(string_split(codes, ','))) AS code, city, site, idx FROM l),
g AS (SELECT code, count(DISTINCT city) > 1 AS conflict, arg_min(coalesce(site, ''), (CASE WHEN site IS NULL THEN 1 ELSE 0 END) * 1000000000 + idx) AS site FROM x GROUP BY code)
SELECT code, CASE WHEN NOT conflict THEN nullif(site, '') END AS site, CASE WHEN conflict THEN 'CITY_CONFLICT' WHEN s_suppkey IS NULL THEN 'CODE_NOT_IN_DB' ELSE 'ok' END AS status
FROM g LEFT JOIN supplier ON code = CAST(s_suppkey AS VARCHAR)""")
def q34_enrichment(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    listed = s.where(k % 4 < 3).select(k.alias("idx"), F.concat_ws(", ", k, k + 2).alias("codes"), (F.col("s_nationkey") % 2).alias("city"), F.when(k % 3 != 0, F.col("s_name")).alias("site"))
    return op.enrichment(listed, s.select(k.cast("string").alias("code")), codes="codes", city="city", site="site", order="idx")


def q35_name_similarity(spark, sf_dir):
    """Rows with the supplier's and the customer's name of one key, alike or NAME_MISMATCH; the ratio has no SQL."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("b"))
    ratio = fields.name_ratio(fields.normal_name(F.col("a")), fields.normal_name(F.col("b")))
    return s.join(c, "k").select("k", "a", "b", ratio.alias("ratio")).withColumn("status", F.when(F.col("ratio") < fields.LEAST_RATIO, "NAME_MISMATCH").otherwise("ok"))


QUERIES["q35_name_similarity"] = q35_name_similarity


@query(CUT + "SELECT inst, family, string_agg(concat(yr, ':', rnd, ':', rnk), ',' ORDER BY yr, rnd, rnk) AS points FROM cut GROUP BY ALL")
def q36_points_array(spark, sf_dir):
    points = op.points(cut(spark, sf_dir, family=True), ["inst", "family"], ["yr", "rnd", "rnk"])
    return points.select("inst", "family", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p.yr, p.rnd, p.rnk)), ",").alias("points"))


@query(CUT + "SELECT inst, ladies, cat, string_agg(DISTINCT rnd, ',' ORDER BY rnd) AS rounds FROM cut GROUP BY ALL")
def q37_nested_options(spark, sf_dir):
    nested = op.nested_options(cut(spark, sf_dir), "inst", "ladies", "cat", "rnd")
    by_ladies = nested.select("inst", F.explode("options").alias("ladies", "cats"))
    return by_ladies.select("inst", "ladies", F.explode("cats").alias("cat", "r")).select("inst", "ladies", "cat", F.array_join(F.col("r").cast("array<string>"), ",").alias("rounds"))


PRIORITIES = ["1-URGENT", "3-MEDIUM", "5-LOW"]


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END AS place FROM orders ORDER BY place, o_orderkey")
def q40_enumerated_sort(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", fields.ordinal(F.col("o_orderpriority"), PRIORITIES).alias("place")).orderBy("place", "o_orderkey")


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, regexp_replace(unnest(string_split(t, chr(10))), '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g') AS line FROM c)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_full_match(line, '[A-Z][A-Z0-9-]{1,14}( [A-Z][A-Z0-9-]{1,14})*') AND NOT regexp_matches(line, '(^| )(II|III|IV|VI|VII|VIII|IX|XI|XII|STAGE)( |$)')) AS n_headers
FROM l WHERE line <> '' GROUP BY doc_id""")
def q44_text_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(fields.text_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(fields.is_category_line(F.col("line"))).alias("n_headers"))


@query(r"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, concat('x ', l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE '' END, ' (', CAST(l_quantity AS INTEGER), '.25) ', l_suppkey, '(7.5) 12 (3)') AS line FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(regexp_extract_all(line, '[0-9]{1,6}[A-Za-z]?\s*\([0-9]+(\.[0-9]+)?\)')) AS m FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(regexp_extract(m, '^([0-9]+)', 1) AS BIGINT) AS rnk, regexp_extract(m, '^[0-9]+([A-Za-z]?)', 1) AS letter, CAST(regexp_extract(m, '\(([0-9.]+)\)', 1) AS DOUBLE) AS pct FROM m""")
def q45_value_regex(spark, sf_dir):
    line = F.concat(F.lit("x "), "l_partkey", F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise(""), F.lit(" ("), F.col("l_quantity").cast("int"), F.lit(".25) "), "l_suppkey", F.lit("(7.5) 12 (3)"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(fields.ranked_values(line)).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "v.rnk", "v.letter", "v.pct")


WORD = "CAST(sum(CAST('0x' || substr(md5(row), {}, 8) AS BIGINT)) AS VARCHAR)"


@query(f"""WITH r AS (SELECT source, concat_ws('|', coalesce(lang, ''), coalesce(text, '')) AS row FROM documents),
f AS (SELECT source, count(*) AS n, concat_ws('-', {', '.join(WORD.format(i) for i in (1, 9, 17, 25))}) AS print FROM r GROUP BY source)
SELECT source, n, print, count(*) OVER (PARTITION BY n, print) > 1 AS duplicate FROM f""")
def q46_fingerprint(spark, sf_dir):
    return op.fingerprints(read(spark, sf_dir, "documents"), "source", ["lang", "text"])


#: Steps that a user's events may take, by state.
STEPS = {"signup": ["view", "error"], "view": ["view", "click", "error"], "click": ["view", "click", "purchase", "error"], "purchase": ["view"]}


@query("""WITH e AS (SELECT event_id, user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
SELECT event_id, user_id, state, previous, CASE WHEN previous IS NULL THEN state = 'signup' WHEN previous = 'signup' THEN state IN ('view', 'error') WHEN previous = 'view' THEN state IN ('view', 'click', 'error')
WHEN previous = 'click' THEN state IN ('view', 'click', 'purchase', 'error') WHEN previous = 'purchase' THEN state = 'view' ELSE FALSE END AS allowed FROM e""")
def q49_state_machine(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("state"))
    return op.check_steps(e, ["user_id"], ["event_id"], "state", STEPS, ["signup"])


@query("""WITH a AS (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part), d AS (SELECT brand, name, row_number() OVER (ORDER BY brand, name) AS id FROM (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part WHERE p_partkey % 3 = 0)),
n AS (SELECT * FROM a EXCEPT SELECT brand, name FROM d)
SELECT brand, name, id FROM d UNION ALL SELECT brand, name, (SELECT coalesce(max(id), 0) FROM d) + row_number() OVER (ORDER BY brand, name) FROM n""")
def q50_surrogate_keys(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    empty = p.select("brand", "name", F.lit(0).cast("bigint").alias("id")).limit(0)
    return op.get_or_create(op.get_or_create(empty, p.where("p_partkey % 3 = 0"), ["brand", "name"], "id"), p, ["brand", "name"], "id")


IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(max({k}) AS BIGINT) AS top FROM {t}" for t, k in IDS.items()))
def q52_health_counts(spark, sf_dir):
    parts = [read(spark, sf_dir, t).agg(F.count("*").alias("n"), F.max(k).cast("bigint").alias("top")).select(F.lit(t).alias("name"), "n", "top") for t, k in IDS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


from . import catalog_export, catalog_load, catalog_panel, catalog_search, catalog_state  # noqa: E402, F401  they add their queries
