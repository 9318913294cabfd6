"""Quality gates of cutoff and seat files: a status for each row, counters for each file, and the number of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields, vocabulary
from ..sources import scans
from ..sources.workspace import kept
from . import ranges
from .relational import join_safe, reconcile


def cutoff_checks(rows: DataFrame, categories: list[str] | None = None, programs: list[str] | None = None) -> DataFrame:
    """rows with base, ladies, stage_code, section_code, number, percentile, and a flag for each check."""
    parts = fields.decompose_category(F.col("category"))
    out = rows.withColumns({"_c": parts, "stage_code": vocabulary.stage(F.col("stage")), "section_code": vocabulary.section(F.col("section")), "number": fields.safe_int(F.trim("rank_number")), "percentile": fields.safe_double(F.trim("percentage"))})
    base = F.col("_c.base")
    known = base.isin(categories) if categories else F.lit(True)
    bad = F.coalesce(base.isNull() | ~known, F.lit(True))
    program = F.trim("program_name")
    return out.withColumns(
        {
            "base": base, "ladies": F.col("_c.ladies"), "anomaly": vocabulary.anomaly(F.col("institution_code"), F.col("institution_name"), F.col("category")), "bad_category": bad,
            "bad_stage": F.col("stage_code").isNull(), "bad_section": (F.trim("section") != "") & F.col("section_code").isNull(),
            "bad_program": (program != "") & ~program.isin(programs) if programs else F.lit(False), "bad_percentage": F.col("percentile").isNull(),
        }
    ).drop("_c")


def load_status(rows: DataFrame, reason: Column, target: DataFrame, keys: list[str], order: list[Column], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """rows with the status that the load gives each, in one pass: the reason, FOREIGN_KEY_FAILED, DUPLICATE_UNIQUE_KEY or inserted.

    parents: for a column the table of the values that it may take (its first column); null fails nothing. A row with a null in its key is never a duplicate;
    such rows, and those with a reason, are spread over windows of their own by their content.
    """
    out = rows.withColumn("status", reason)
    for column, table in (parents or {}).items():
        known = table.select(F.col(table.columns[0]).alias(column)).distinct().withColumn("_parent", F.lit(True))
        out = out.join(known, column, "left").withColumn("status", F.coalesce("status", F.when(F.col("_parent").isNull() & F.col(column).isNotNull(), "FOREIGN_KEY_FAILED"))).drop("_parent")
    whole = F.col("status").isNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    known = target.select(*keys).dropna().distinct().withColumn("_known", F.lit(True))
    placed = out.withColumns({"_whole": whole, "_salt": F.when(whole, 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int"))}).join(known, keys, "left")
    n = F.row_number().over(Window.partitionBy("_whole", "_salt", *keys).orderBy(*order))
    again = F.col("_whole") & ((F.col("_n") > 1) | F.col("_known").isNotNull())
    return placed.withColumn("_n", n).withColumn("status", F.coalesce("status", F.when(again, "DUPLICATE_UNIQUE_KEY").otherwise("inserted"))).drop("_whole", "_salt", "_n", "_known")


def cutoff_status(rows: DataFrame, target: DataFrame, keys: list[str], order: list[Column], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """cutoff_checks() with the status that the load gives a row, the first that applies; target holds the keys loaded before."""
    reason = F.when(F.col("anomaly"), "EXTRACTION_ANOMALY").when(F.col("base").isNull(), "UNKNOWN_CATEGORY").when(F.col("bad_stage"), "UNKNOWN_STAGE").when(F.col("section_code").isNull(), "UNKNOWN_SECTION").when(F.col("bad_percentage"), "BAD_PERCENTAGE")
    return load_status(cutoff_checks(rows), reason, target, keys, order, parents)


# Columns that a file prints once a block; the stage isn't one of them, as whole files leave it blank.
BLOCK = ["institution_code", "institution_name", "program_code", "program_name", "status", "section"]


def cutoff_gate(rows: DataFrame, row: str, categories: list[str] | None = None, programs: list[str] | None = None, block: list[str] | None = None, by: str = "source_file") -> dict[str, DataFrame]:
    """The whole gate of delivered cutoff rows: block columns are filled within each file in the order of `row`, then every check runs.

    report: counters of each file, with filled cells and rows whose key is repeated; errors: files whose name has no family, year and round or whose first
    row is blank in a block column; issues: unknown values; total: the number of issues and errors, in one row.
    """
    block = block or [c for c in BLOCK if c in rows.columns]
    blank = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in block}
    marked = rows.withColumns({f"_was_{c}": v for c, v in blank.items()})
    filled = kept(ranges.carried(marked, block, [row], [by]).withColumn("_filled", sum((F.col(f"_was_{c}") & ~blank[c]).cast("int") for c in block)), "gate")
    checked = cutoff_checks(filled, categories, programs)
    repeated = filled.groupBy(by, "institution_code", "program_name", "category", "section", "stage", "rank_number", "percentage").agg(F.count("*").alias("n")).where("n > 1").groupBy(by).agg(F.sum("n").alias("duplicates"))
    fills = filled.groupBy(by).agg(F.sum("_filled").alias("filled"))
    report = cutoff_report(checked, by).join(fills, by, "left").join(repeated, by, "left").na.fill(0, ["filled", "duplicates"])
    first = filled.groupBy(by).agg(F.min_by(F.array_compact(F.array(*(F.when(blank[c], F.lit(c)) for c in block))), row).alias("b"))
    starts = first.where("size(b) > 0").select(by, F.concat(F.lit("FIRST_ROW_BLANK: "), F.array_join("b", ", ")).alias("error"))
    names = scans.named(first.select(by), F.col(by)).where("file_error is not null").select(by, F.col("file_error").alias("error"))
    errors, issues = names.unionByName(starts), cutoff_issues(checked)
    total = issues.select(F.lit(1).alias("x")).unionByName(errors.select(F.lit(1).alias("x"))).agg(F.count("*").alias("total"))
    return {"report": report, "errors": errors, "issues": issues, "total": total}


def cutoff_report(checked: DataFrame, by: str = "source_file") -> DataFrame:
    """Counters of each file. Rows that are anomalies count as such only."""
    fine = ~F.col("anomaly")
    return checked.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if("anomaly").alias("anomaly"), *(F.count_if(fine & F.col(c)).alias(c) for c in ("bad_category", "bad_stage", "bad_section", "bad_program", "bad_percentage")))


def cutoff_issues(checked: DataFrame) -> DataFrame:
    """kind, value, n: the unknown values of each kind. Their number, with the file errors, is the number of issues."""
    fine = checked.where(~F.col("anomaly"))
    kinds = [("category", F.col("category")), ("stage", F.col("stage")), ("section", F.trim("section")), ("program", F.trim("program_name"))]
    parts = [fine.where(F.col(f"bad_{k}")).groupBy(v.alias("value")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "value", "n") for k, v in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seat_status(rows: DataFrame, target: DataFrame, keys: list[str], order: list[Column], categories: list[str], lanes: dict[str, str], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """rows with code, lane_code, base, is_total, ladies, n_seats and the status that the load gives a row."""
    cat, code = F.trim("category"), vocabulary.institution_code(F.col("institution_code"), F.col("choice_code"))
    base = F.when(cat != vocabulary.TOTAL, vocabulary.category_alias(cat))
    out = rows.withColumns({"_code": code, "lane_code": fields.mapped(F.trim("allocation_type"), lanes), "is_total": cat == vocabulary.TOTAL, "base": base, "ladies": vocabulary.gender(F.col("gender")), "n_seats": vocabulary.whole_number(F.col("seats"))})
    reason = F.when(cat.isin(vocabulary.NO_CATEGORIES), "QUARANTINED_EXTRACTION_ANOMALY").when(~F.col("_code.ok"), "CODE_MISMATCH").when(F.col("lane_code").isNull(), "UNKNOWN_LANE")
    reason = reason.when(~F.col("is_total") & ~F.col("base").isin(categories), "UNKNOWN_CATEGORY").when(F.col("n_seats").isNull(), "BAD_SEATS")
    out = out.withColumn("code", F.col("_code.code"))
    return load_status(out, reason, target, keys, order, parents).drop("_code")


def seat_diff(rows: DataFrame, seats: DataFrame, lanes: dict[str, str], year: int, family: str) -> DataFrame:
    """Delivered seat rows with change: present or new. Keys are (institute, choice, lane, category, gender) as stored, so codes and lanes are made canonical first."""
    keys = ["institution_code", "choice_code", "allocation_lane", "raw_category", "raw_gender"]
    code = vocabulary.institution_code(F.col("institution_code"), F.col("choice_code"))["code"]
    named = rows.select(code.alias(keys[0]), F.trim("choice_code").alias(keys[1]), fields.mapped(F.trim("allocation_type"), lanes, F.trim("allocation_type")).alias(keys[2]), F.trim("category").alias(keys[3]), F.trim(F.coalesce("gender", F.lit(""))).alias(keys[4]))
    old = seats.where((F.col("capture_year") == year) & (F.col("program_family") == family)).select(*keys).distinct()
    present = join_safe(named, old.withColumn("_old", F.lit(True)), keys, "left")
    return present.withColumn("change", F.when(F.col("_old"), "present").otherwise("new")).drop("_old")


def seat_mismatches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lanes whose categories don't add up to their printed sum."""
    return reconcile(rows, keys, F.col("category") == vocabulary.TOTAL, F.trim("seats").try_cast("double"))


def page_audit(rows: DataFrame, errors: DataFrame, method: str = "method") -> DataFrame:
    """source_file, page, records, errors and methods (distinct, joined by '+') of each page that has either; counted in one pass over both."""
    by = ["source_file", "page"]
    both = rows.select(*by, F.lit(True).alias("_r"), F.col(method).alias("_m")).unionByName(errors.select(*by, F.lit(False).alias("_r"), F.lit(None).cast("string").alias("_m")))
    return both.groupBy(*by).agg(F.count_if("_r").alias("records"), F.count_if(~F.col("_r")).alias("errors"), F.array_join(F.sort_array(F.collect_set("_m")), "+").alias("methods"))


def split(rows: DataFrame, reason: Column, name: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and those with one and the reason."""
    marked = rows.withColumn(name, reason)
    return marked.where(F.col(name).isNull()).drop(name), marked.where(F.col(name).isNotNull())


def blank_category(category: Column) -> Column:
    """The cleaner's reason."""
    return F.when(F.trim(F.coalesce(category, F.lit(""))) == "", "BLANK_CATEGORY")
