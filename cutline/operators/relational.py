"""Relational operators of the load and of the analytics, as plans over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.workspace import kept


def join_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal; the keys are those of left."""
    names = {k: f"_right {k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, v in names.items():
        on = on & left[k].eqNullSafe(renamed[v])
    return left.join(renamed, on, how).drop(*names.values()) if how not in ("left_anti", "left_semi") else left.join(renamed, on, how)


def forward_fill(df: DataFrame, columns: list[str], block: list[str], order: list[str]) -> DataFrame:
    """Blank or null cells take the last non-blank value (trimmed) of their block in row order."""
    w = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.last(F.nullif(F.trim(c), F.lit("")), ignorenulls=True).over(w)).otherwise(F.col(c)) for c in columns}
    return df.withColumns(filled)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark cuts each task's rows to one of a key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_snapshot(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of the highest version of each key, by an aggregate and a join, so that no key is gathered in one window."""
    top = df.groupBy(*keys).agg(F.max(version).alias("_v"))
    return df.join(top, keys).where(F.col(version) == F.col("_v")).drop("_v")


def flag_duplicates(df: DataFrame, keys: list[str], name: str = "duplicate") -> DataFrame:
    """Marks all rows whose key occurs more than once, null keys too; the counts are combined before they are shuffled."""
    return join_safe(df, df.groupBy(*keys).agg((F.count("*") > 1).alias(name)), keys, "inner")


def insert_new(batch: DataFrame, target: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """batch with status inserted or duplicate; a row with a null in its key is never a duplicate."""
    known = target.select(*keys).dropna().distinct().withColumn("_known", F.lit(True))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = batch.where(whole).join(known, keys, "left").withColumn("_n", rank)
    loaded = joined.withColumn("status", F.when(F.col("_known").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("inserted")).drop("_known", "_n")
    return loaded.unionByName(batch.where(~whole).withColumn("status", F.lit("inserted")))  # null keys aren't gathered in one window


def upsert(target: DataFrame, patch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of the patch replace those of their key. Of a key's rows in the patch the first by order counts (any, if none is given)."""
    one = first_row(patch, keys, order) if order else patch.dropDuplicates(keys)
    return join_safe(target, one.select(*keys), keys, "left_anti").unionByName(one.select(*target.columns))


def update_matched(target: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Matched rows take the patch's values, nulls too; nothing is inserted. Of a key's rows in the patch any one counts."""
    p = patch.dropDuplicates(keys).select(*keys, F.struct(*columns).alias("_p"), F.lit(True).alias("_m"))
    out = join_safe(target, p, keys, "left")
    return out.withColumns({c: F.when(F.col("_m"), F.col(f"_p.{c}")).otherwise(F.col(c)) for c in columns}).drop("_p", "_m")


def rollback(target: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(items.select(*keys), keys, "left_anti")


def snapshot_diff(new: DataFrame, old: DataFrame, identity: list[str], values: list[str], order: list[Column] | None = None) -> DataFrame:
    """new and change: exact, changed or new; null keys and values are equal to null ones.

    With an order, also repeated: whether an equal row of the input comes before.
    """
    seen = old.groupBy(*identity).agg(F.collect_set(F.struct(*values)).alias("_old"))
    change = F.when(F.col("_old").isNull(), "new").when(F.array_contains("_old", F.struct(*values)), "exact").otherwise("changed")
    out = join_safe(new, seen, identity, "left").withColumn("change", change).drop("_old")
    return out.withColumn("repeated", F.row_number().over(Window.partitionBy(*identity, *values).orderBy(*order)) > 1) if order else out


def reconcile(df: DataFrame, keys: list[str], is_total: Column, value: Column) -> DataFrame:
    """Keys whose parts don't add up to the printed total; keys without either side are left out."""
    sums = df.groupBy(*keys).agg(F.sum(F.when(~is_total, value)).alias("parts"), F.sum(F.when(is_total, value)).alias("total"))
    return sums.where(F.col("parts").isNotNull() & F.col("total").isNotNull() & (F.col("parts") != F.col("total")))


def points(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and points: the rows of each key as an array of structs, sorted by their fields."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("points"))


def nested_options(df: DataFrame, key: str, first: str, second: str, value: str) -> DataFrame:
    """key and options: first -> second -> sorted distinct values; each level is combined before it is nested."""
    sets = df.groupBy(key, first, second).agg(F.sort_array(F.collect_set(value)).alias("_v"))
    inner = sets.groupBy(key, first).agg(F.map_from_entries(F.collect_list(F.struct(second, "_v"))).alias("_m"))
    return inner.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(first, "_m"))).alias("options"))


def enrichment(listed: DataFrame, known: DataFrame, codes: str, city: str, site: str, order: str) -> DataFrame:
    """code, site and status of each code of a comma-separated cell: CITY_CONFLICT, CODE_NOT_IN_DB or ok.

    Of several rows with a code the first with a site counts, else the first. known has a distinct column code.
    """
    rows = listed.select(F.explode(F.split(codes, ",")).alias("_c"), city, site, order).withColumn("code", F.trim("_c")).where("code <> ''")
    best = F.min_by(F.struct(site), F.struct(F.col(site).isNull(), F.col(order)))[site]
    each = rows.groupBy("code").agg((F.count_distinct(city) > 1).alias("_conflict"), best.alias("_site"))
    found = each.join(known.select("code", F.lit(True).alias("_known")), "code", "left")
    status = F.when(F.col("_conflict"), "CITY_CONFLICT").when(F.col("_known").isNull(), "CODE_NOT_IN_DB").otherwise("ok")
    return found.select("code", F.when(~F.col("_conflict"), F.col("_site")).alias("site"), status.alias("status"))


def fingerprints(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, n, print and duplicate: sums of the rows' digests don't depend on row order and are combined before the shuffle."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in columns)))
    words = [F.sum(F.conv(F.substr("_d", F.lit(i), F.lit(8)), 16, 10).cast("bigint")).cast("string") for i in (1, 9, 17, 25)]
    each = df.select(key, digest.alias("_d")).groupBy(key).agg(F.count("*").alias("n"), F.concat_ws("-", *words).alias("print"))
    return flag_duplicates(each, ["n", "print"]).select(key, "n", "print", "duplicate")


def check_steps(df: DataFrame, keys: list[str], order: list[str], state: str, steps: dict[str, list[str]], starts: list[str]) -> DataFrame:
    """df with the previous state of each row's key and whether the step is allowed; a first row must be a start state."""
    out = df.withColumn("previous", F.lag(state).over(Window.partitionBy(*keys).orderBy(*order)))
    allowed = F.when(F.col("previous").isNull(), F.col(state).isin(starts))
    for before, after in steps.items():
        allowed = allowed.when(F.col("previous") == before, F.col(state).isin(after))
    return out.withColumn("allowed", allowed.otherwise(False))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df in the order of keys with a number from 1: ranges of keys are written once, counted, and shifted by the counts before."""
    parts = df.repartitionByRange(*(F.asc(k) for k in keys)).sortWithinPartitions(*keys)
    once = kept(parts.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = once.groupBy("_p").agg(F.count("*").alias("_c"))  # a row a partition
    shift = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_shift"))
    return once.join(F.broadcast(shift), "_p").withColumn(name, F.col("_shift") + F.col("_i") + 1).drop("_p", "_i", "_shift")


def get_or_create(dim: DataFrame, rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """dim and the keys of rows that it lacks (null keys are equal), numbered on from its largest number in the order of keys."""
    new = join_safe(rows.select(*keys).distinct(), dim.select(*keys), keys, "left_anti")
    top = dim.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
    fresh = numbered(new, keys, "_n").select(*keys, (F.lit(top) + F.col("_n")).cast(dim.schema[number].dataType).alias(number))
    return dim.select(*keys, number).unionByName(fresh)


def append_absent(df: DataFrame, row: DataFrame, keys: list[str]) -> DataFrame:
    """df and the rows of row whose key it lacks."""
    return df.unionByName(join_safe(row, df.select(*keys), keys, "left_anti").select(*df.columns))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with what the table has for their key, and the number of rows that it lacks."""
    missed = rows.join(table.select(*keys), keys, "left_anti").agg(F.count("*").alias("missed"))
    return rows.join(table, keys), missed


def merge_records(rows: DataFrame, keys: list[str], source: str, priority: dict[str, int], last: int = 99) -> DataFrame:
    """One row for each key: each field from the first source, by priority, that fills it; merged_from lists the sources.

    Fields that are null, '' or 0 don't fill.
    """
    rank = F.lit(last)
    for k, v in priority.items():
        rank = F.when(F.col(source) == k, v).otherwise(rank)
    rows = rows.withColumn("_rank", rank)
    fields = [c for c in rows.columns if c not in (*keys, source, "_rank")]
    filled = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.coalesce(F.col(c).try_cast("double"), F.lit(1.0)) != 0 if not isinstance(rows.schema[c].dataType, StringType) else F.lit(True)) for c in fields}
    best = [F.min(F.when(filled[c], F.struct("_rank", F.col(source).alias("s"), F.col(c).alias("v"))))["v"].alias(c) for c in fields]
    sources = F.array_sort(F.collect_set(F.struct("_rank", F.col(source).alias("s"))))
    each = rows.groupBy(*keys).agg(*best, sources.alias("_s"))
    return each.select(*keys, *fields, F.col("_s")[0]["s"].alias(source), F.transform("_s", lambda x: x["s"]).alias("merged_from"))


def merge_adjacent(rows: DataFrame, block: list[str], order: list[str], text: str, joins: Column) -> DataFrame:
    """A row for which joins holds (on text and previous, the text of the row before) is added to the row before it and goes."""
    w = Window.partitionBy(*block).orderBy(*order)
    flagged = rows.withColumn("previous", F.lag(text).over(w)).withColumn("_j", F.coalesce(joins, F.lit(False)))
    out = flagged.withColumns({"_next": F.lead(text).over(w), "_nj": F.coalesce(F.lead("_j").over(w), F.lit(False))})
    merged = out.withColumn(text, F.when(F.col("_nj"), F.concat_ws(" ", text, "_next")).otherwise(F.col(text)))
    return merged.where(~F.col("_j")).drop("previous", "_j", "_next", "_nj")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two multisets has; empty if they are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns that it lacks."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def stamped(df: DataFrame, column: str = "created_at") -> DataFrame:
    """df whose missing or null times are the query's own, the same in all rows."""
    now = F.current_timestamp()
    return df.withColumn(column, F.coalesce(F.col(column), now) if column in df.columns else now)


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows that break an enumeration; null breaks none."""
    return df.where(~F.col(column).isin(allowed))
