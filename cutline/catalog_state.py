"""Queries of releases, state carried over ranges, bands, stored states, examples, files, subtotals and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registered import query, read
from .functions import fields
from .operators import ranges, states
from .operators import relational as op
from .sources import scans, sinks, versions
from .sources.workspace import new_folder


@query("""WITH a AS (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS k, concat(s_name, '!') AS v FROM supplier)
SELECT 'first' AS release, k, v FROM a UNION ALL SELECT 'second', k, v FROM b UNION ALL SELECT 'after refusal', k, v FROM b UNION ALL SELECT 'after rollback', k, v FROM a UNION ALL SELECT 'untouched', n_nationkey, n_name FROM nation""")
def q85_releases(spark, sf_dir):
    root, rows = new_folder(spark, "releases"), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    seen = []

    def look(name, table="names"):
        seen.append(versions.read(spark, root, table).select(F.lit(name).alias("release"), "k", "v"))

    def repeats(tables):
        return tables["names"].groupBy("k").count().where("count > 1")

    versions.promote(spark, root, {"names": rows.where("k % 2 = 0"), "nations": nations}, repeats)
    look("first")
    versions.promote(spark, root, {"names": rows.withColumn("v", F.concat("v", F.lit("!")))}, repeats)
    look("second")
    try:
        versions.promote(spark, root, {"names": rows.unionByName(rows)}, repeats)
    except versions.PromotionError:
        look("after refusal")
    versions.rollback(spark, root)
    look("after rollback")
    look("untouched", "nations")
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out


PAGES = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 20 = 0 THEN concat('head ', l_suppkey) WHEN l_partkey % 3 = 0 THEN ' ' END AS heading, l_orderkey % 3 AS file FROM lineitem) """


#: The order of lines; orders and numbers repeat.
LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def pages(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    head = F.when(F.col("l_partkey") % 20 == 0, F.concat(F.lit("head "), "l_suppkey")).when(F.col("l_partkey") % 3 == 0, " ")
    return li.select(*LINES, head.alias("heading"), (F.col("l_orderkey") % 3).alias("file"))


@query(PAGES + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(nullif(trim(heading), '') IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS heading FROM p")
def q86_carried_over_one_file(spark, sf_dir):
    return ranges.carried(pages(spark, sf_dir).drop("file"), ["heading"], LINES)


@query(PAGES + "SELECT file, l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(nullif(trim(heading), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS heading FROM p")
def q87_carried_over_pages(spark, sf_dir):
    return ranges.carried(pages(spark, sf_dir), ["heading"], LINES, ["file"])


@query("""SELECT c_custkey, s_suppkey, CAST(round(c_acctbal * 100) AS BIGINT) AS asked, CAST(round(s_acctbal * 100) AS BIGINT) AS offered FROM customer JOIN supplier
ON round(s_acctbal * 100) BETWEEN round(c_acctbal * 100) - 500 AND round(c_acctbal * 100) + 500""")
def q88_within_five(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("asked"))
    offered = read(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") * 100).cast("bigint").alias("offered"))
    return ranges.band_join(asked, offered, "asked", "offered", 500)


@query("""SELECT l_suppkey AS institution_code, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS round, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY ALL""")
def q89_refreshed_states(spark, sf_dir):
    """Two loads, of which the second touches only late years, equal a rebuild."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("institution_code"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("round"), "l_extendedprice", "l_linenumber")
    path, late = new_folder(spark, "states"), (F.col("year") >= 1997) & (F.col("l_linenumber") > 2)
    for batch in (li.where(~late), li.where(late), li.where(late)):
        out = states.refresh(path, batch, ["institution_code", "year", "round"], "year", {"low": "l_extendedprice"}, {"high": "l_extendedprice"})
    return out.select("institution_code", "year", "round", "low", "high")


@query("""SELECT * FROM (SELECT CASE WHEN l_quantity > 45 THEN 'BAD_PERCENTAGE' WHEN l_partkey % 97 = 0 THEN 'ANOMALY' WHEN l_suppkey % 13 = 0 THEN NULL ELSE 'KEPT' END AS reason, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  row_number() OVER (PARTITION BY reason ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS example FROM lineitem) WHERE example <= 100""")
def q90_first_examples(spark, sf_dir):
    reason = F.when(F.col("l_quantity") > 45, "BAD_PERCENTAGE").when(F.col("l_partkey") % 97 == 0, "ANOMALY").when(F.col("l_suppkey") % 13 == 0, None).otherwise("KEPT")
    rows = read(spark, sf_dir, "lineitem").select(reason.alias("reason"), *LINES, "l_quantity")
    return states.first_examples(rows, "reason", [*LINES, "l_quantity"], 100)


@query("""WITH f AS (SELECT n_nationkey, sha256(concat('region ', n_regionkey, chr(10))) AS sha256, 9 AS size FROM nation)
SELECT n_nationkey, CAST(size AS BIGINT) AS size, sha256, count(*) OVER (PARTITION BY size, sha256) AS copies FROM f""")
def q91_equal_files(spark, sf_dir):
    """A file for each nation that names its region; files of one region are equal."""
    folder = new_folder(spark, "files")
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("region "), "n_regionkey").alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return scans.hashed(spark, folder, "part-*", ["n_nationkey"]).drop("source_file")


@query("""SELECT name, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS place FROM (SELECT concat(o_orderpriority, ' ', o_orderstatus) AS name, min((o_custkey, o_orderkey)) AS first FROM orders GROUP BY 1)""")
def q92_columns_as_first_seen(spark, sf_dir):
    """The header of a wide file: a column for each kind in the order in which rows bring it."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name"), F.lit(1).alias("n"))
    columns = sinks.wide(o.dropDuplicates(["o_custkey", "name"]), ["o_custkey"], "name", "n", names=sinks.first_seen(o, "name", ["o_custkey", "o_orderkey"])).columns[1:]
    return spark.createDataFrame([(c, i) for i, c in enumerate(columns, 1)], "name string, place int")


@query("""SELECT o_custkey AS institution_code, o_orderpriority AS lane, o_orderstatus AS category, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS value, grouping(o_orderstatus) = 1 AS is_total
FROM orders GROUP BY GROUPING SETS ((o_custkey, o_orderpriority, o_orderstatus), (o_custkey, o_orderpriority))""")
def q93_subtotal_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("institution_code"), F.col("o_orderpriority").alias("lane"), F.col("o_orderstatus").alias("category"), F.floor("o_totalprice").alias("seats"))
    return states.with_totals(o, ["institution_code", "lane"], "category", F.col("seats"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, concat('say "', l_returnflag, '", twice', CASE WHEN l_partkey % 5 = 0 THEN chr(10) || 'and again' ELSE '' END) AS remark, concat('n', l_suppkey) AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 2 THEN '' ELSE remark END AS remark, name, CASE l_linenumber % 3 WHEN 0 THEN 'a.csv' WHEN 1 THEN 'b.csv' ELSE 'c.csv' END AS layout FROM c""")
def q94_files_of_different_layouts(spark, sf_dir):
    """Three files: quotes, commas and line breaks in cells, columns in another order, and a column that one file lacks."""
    folder, k = new_folder(spark, "layouts"), F.col
    remark = F.concat(F.lit('say "'), "l_returnflag", F.lit('", twice'), F.when(k("l_partkey") % 5 == 0, "\nand again").otherwise(""))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", remark.alias("remark"), F.concat(F.lit("n"), "l_suppkey").alias("name"))
    for i, (layout, columns) in enumerate({"a.csv": ["l_orderkey", "l_linenumber", "remark", "name", "layout"], "b.csv": ["name", "layout", "remark", "l_linenumber", "l_orderkey"], "c.csv": ["layout", "l_linenumber", "name", "l_orderkey"]}.items()):
        sinks.csv(rows.where(k("l_linenumber") % 3 == i).withColumn("layout", F.lit(layout)), f"{folder}/{i}", columns)
    paths = [p for i in range(3) for p in scans.files(spark, f"{folder}/{i}")]
    got = scans.strings(spark, paths, ["l_orderkey", "l_linenumber", "remark", "name", "layout"], ["name"])
    return got.withColumns({"l_orderkey": k("l_orderkey").cast("bigint"), "l_linenumber": k("l_linenumber").cast("int")}).drop("source_file")


@query("""SELECT l_orderkey, l_linenumber, r_name AS word FROM lineitem LEFT JOIN (SELECT concat('k', r_regionkey) AS k, r_name FROM region) ON k = concat('k', l_partkey % 7)""")
def q95_vocabulary_from_a_file(spark, sf_dir):
    folder = new_folder(spark, "list")
    sinks.csv(read(spark, sf_dir, "region").select(F.concat(F.lit(" k"), "r_regionkey").alias("alias"), F.col("r_name").alias("full")), folder, ["alias", "full"])
    words = scans.vocabulary(spark, scans.files(spark, folder), "alias", "full")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("k"), F.col("l_partkey") % 7, F.lit(" ")).alias("cell"))
    return scans.listed(rows, "cell", words, "word").drop("cell")


@query("""SELECT l_orderkey, l_linenumber, json_extract_string(m, '$.a') AS a, json_extract_string(m, '$.b') AS b, json_extract_string(m, '$.c.d') AS d FROM
(SELECT l_orderkey, l_linenumber, json_merge_patch(json_object('a', l_partkey, 'b', l_returnflag), json_object('b', l_suppkey, 'c', json_object('d', l_linestatus))) AS m FROM lineitem)""")
def q96_merged_json(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    left = F.to_json(F.struct(F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("b")))
    right = F.to_json(F.struct(F.col("l_suppkey").alias("b"), F.struct(F.col("l_linestatus").alias("d")).alias("c")))
    m = li.select("l_orderkey", "l_linenumber", fields.json_merge(left, right).alias("m"))
    return m.select("l_orderkey", "l_linenumber", *(F.get_json_object("m", p).alias(n) for n, p in (("a", "$.a"), ("b", "$.b"), ("d", "$.c.d"))))


@query("""SELECT event_id, event_type, row_number() OVER (ORDER BY (event_id % 3 = 0), ts, event_id) AS sequence FROM events""")
def q97_event_log(spark, sf_dir):
    """Two batches, of which the second comes twice and overlaps the first."""
    path, rows = new_folder(spark, "log"), read(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    states.append_events(path, rows.where("event_id % 3 <> 0"), "event_id", ["ts"])
    late = rows.where("event_id % 3 = 0 or event_id % 5 = 1")
    states.append_events(path, late, "event_id", ["ts"])
    return states.append_events(path, late, "event_id", ["ts"]).drop("ts")


@query("""SELECT o_orderkey, CASE WHEN c_name IS NULL THEN 'missed' ELSE c_name END AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""")
def q98_looked_up_and_missed(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    found, missed = op.looked_up(orders, read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name"), ["c_custkey"])
    rest = orders.join(found, "o_orderkey", "left_anti").select("o_orderkey", F.lit("missed").alias("name"))
    return found.select("o_orderkey", F.col("c_name").alias("name")).unionByName(rest)
