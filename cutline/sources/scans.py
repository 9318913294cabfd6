"""Scans of delivered files: CSV with every cell a string, JSON documents, staged rows, database tables."""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOM = "\ufeff"
#: Names of delivered files. Family, two-digit year and round of a cutoff file; family of a seat file.
CUTOFF_NAME = r"(?i)^(BCA|BBA|MBA|MCA)_([0-9]{2})_C([0-9])"
SEAT_NAME = r"(?i)^(BCA|BBA|MBA|MCA)_SM"
#: What the name of any uploaded file may say; the families are tried in this order.
FAMILIES = ["BCA", "BBA", "MBA", "MCA"]
SEAT_MARK = "_SM|SEAT"
ANY_YEAR, ANY_ROUND = r"(?:^|[_\-. ])(20[0-9]{2}|[0-9]{2})(?=[_\-. ]|$)", r"(?<![A-Z0-9])(C[0-9])(?![A-Z0-9])"


def files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Paths below the folder with the suffix, sorted; a folder without any raises."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().toString() for s in found if s.getPath().getName().endswith(suffix))
    if not names:
        raise FileNotFoundError(f"no {suffix} file in {folder}")
    return names


def header(spark: SparkSession, path: str, size: int = 1 << 16) -> list[str]:
    """Column names of a CSV file, without a byte order mark, from its first bytes; quoted names may hold commas and line breaks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        text = bytes(stream.readNBytes(size)).decode("utf-8-sig", "replace")
    finally:
        stream.close()
    return next(csv.reader(io.StringIO(text)), [])


def layouts(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header. The driver reads the first bytes of a file, never its rows."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        found.setdefault(tuple(header(spark, path)), []).append(path)
    return found


def missing_columns(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    have = header(spark, path)
    return [c for c in required if c not in have]


def missing_report(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """source_file and the required columns that it lacks; only files that lack any."""
    lacking = [(path.rsplit("/", 1)[-1], [c for c in required if c not in names]) for names, group in layouts(spark, paths).items() for path in group]
    return spark.createDataFrame([x for x in lacking if x[1]], "source_file string, missing array<string>")


def strings(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, required: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Rows of CSV files: every cell a string, blanks kept as '', and source_file, the file's name.

    Files may have their columns in different orders: there is one scan for each header, and rows are united by name; a cell whose file
    has no such column is ''. Quotes in a quoted cell are doubled. A file that lacks a required column raises. columns prunes the scan.
    multi_line: quoted cells may hold line breaks, so that a file is read by one task; without, files are split.
    """
    paths = [paths] if isinstance(paths, str) else paths
    found = layouts(spark, paths)
    lacking = {path.rsplit("/", 1)[-1]: gone for names, group in found.items() if (gone := [c for c in required or [] if c not in names]) for path in group}
    if lacking:
        raise ValueError(f"MISSING_COLUMNS: {lacking}")
    wanted = columns or list(dict.fromkeys(c for names in found for c in names))
    out = None
    for names, group in found.items():
        schema = StructType([StructField(n, StringType()) for n in names])
        reader = spark.read.schema(schema).options(header=True, encoding="UTF-8", enforceSchema=True, multiLine=multi_line, quote='"', escape='"', nullValue="\0", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        rows = reader.csv(group)
        file = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file")
        cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in wanted]
        out = rows.select(*cells, file) if out is None else out.unionByName(rows.select(*cells, file))
    return out


def vocabulary(spark: SparkSession, paths: str | list[str], name: str, target: str | None = None) -> DataFrame:
    """name and target of a list or of an alias table kept as CSV: trimmed, without blanks, a name once (the smaller target of several)."""
    rows = strings(spark, paths, [name, *([target] if target else [])])
    pair = rows.select(F.trim(name).alias("name"), F.trim(target or name).alias("target")).where("name <> ''")
    return pair.groupBy("name").agg(F.min("target").alias("target"))


def listed(rows: DataFrame, column: str, words: DataFrame, result: str, small: int = 100_000) -> DataFrame:
    """rows with result: what the vocabulary (name, target) has for the trimmed column, null where it has nothing. It is broadcast up to `small` names."""
    table = words.select(F.col("name").alias("_name"), F.col("target").alias(result))
    if words.limit(small + 1).count() <= small:
        table = F.broadcast(table)
    return rows.join(table, F.trim(F.col(column)) == F.col("_name"), "left").drop("_name")


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    names = []
    while found.hasNext():
        s = found.next()
        if s.getLen() == 0:
            names.append(s.getPath().getName())
    return names


def hashed(spark: SparkSession, path: str, pattern: str = "*", by: list[str] | None = None) -> DataFrame:
    """source_file, size, sha256 and copies (files of equal content) of every file below path; contents are hashed where they are read.

    Empty files, which Spark's readers skip, are listed by the driver. by: columns that directories name (name=value), as they
    are inferred; empty files are left out then.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    found = (found if by else found.option("recursiveFileLookup", True)).load(path)
    names = by or []
    each = found.select(*names, F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if not by:
        empty = [(n, 0, hashlib.sha256().hexdigest()) for n in _empty_files(spark, path) if fnmatch.fnmatch(n, pattern)]
        each = each.unionByName(spark.createDataFrame(empty, "source_file string, size long, sha256 string"))
    same = each.groupBy("size", "sha256").agg(F.count("*").alias("copies"))
    return each.join(same, ["size", "sha256"]).select(*names, "source_file", "size", "sha256", "copies")


def named(rows: DataFrame, name: Column, pattern: str = CUTOFF_NAME) -> DataFrame:
    """rows with family, year and round of the file's name, or file_error FILENAME_PATTERN_MISMATCH."""
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    rows = rows.withColumn("family", F.upper(part(1)))
    if pattern == CUTOFF_NAME:
        rows = rows.withColumns({"year": (F.lit(2000) + part(2).cast("int")), "round": part(3).cast("int")})
    return rows.withColumn("file_error", F.when(F.col("family").isNull(), "FILENAME_PATTERN_MISMATCH"))


def identified(rows: DataFrame, name: Column) -> DataFrame:
    """rows with kind (SEATS or CUTOFFS), family, year, round and confidence (the share of the last three that was found) of any file name."""
    upper = F.upper(name)
    first = lambda pattern: F.nullif(F.regexp_extract(upper, pattern, 1), F.lit(""))
    family = F.coalesce(*(F.when(upper.contains(f), f) for f in FAMILIES))
    year = first(ANY_YEAR).cast("int")
    out = rows.withColumns({"kind": F.when(upper.rlike(SEAT_MARK), "SEATS").otherwise("CUTOFFS"), "family": family, "year": F.when(year < 100, year + 2000).otherwise(year), "round": first(ANY_ROUND)})
    return out.withColumn("confidence", sum(F.col(c).isNotNull().cast("int") for c in ("family", "year", "round")) / 3)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one of several lines each or one a line, by a schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def staged(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows kept as JSON text, by a schema; a text that is no such row gives nulls."""
    return rows.withColumn("_row", F.from_json(column, schema)).select(*(c for c in rows.columns if c != column), "_row.*")


def database(spark: SparkSession, url: str, table: str, partition: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table over JDBC; with a partition column it is read by several tasks. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        reader = reader.options(partitionColumn=partition, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()
