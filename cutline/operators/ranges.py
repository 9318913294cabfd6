"""Operators over ranges of an order: state carried from one range to the next, and joins within a band of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import kept

#: Groups that a broadcast may hold: as a hot bucket has at least one in HOT of all rows, there are no more of them.
HOT = 4096


def carried(rows: DataFrame, columns: list[str], order: list[str], block: list[str] | None = None) -> DataFrame:
    """rows in which blank or null cells take the last filled value (trimmed) before them in their block; the whole table is one block if none is named.

    A prefix scan, so that a block of any length is spread: rows are sorted into ranges of (block, order) once; of each range and
    block the last filled values are one row, and the last of these before a range is what it starts with. Within
    a range the values go on by row, so no task reads more than its range.
    """
    block = block or []
    keys = [F.asc_nulls_first(c) for c in (*block, *order)]
    filled = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns}
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    once = kept(sorted_rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "carried")
    named = once.withColumns({f"_b{k}": F.col(c) for k, c in enumerate(block)})
    marks = [f"_b{k}" for k in range(len(block))]
    lasts = named.groupBy("_p", *marks).agg(*(F.max_by(filled[c], F.when(filled[c].isNotNull(), F.col("_i"))).alias(f"_l{k}") for k, c in enumerate(columns)))
    before = Window.partitionBy(*marks).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = lasts.select("_p", *marks, *(F.last(f"_l{k}", ignorenulls=True).over(before).alias(f"_s{k}") for k in range(len(columns))))
    starts = starts.withColumnsRenamed({"_p": "_q", **{m: f"{m}q" for m in marks}})
    met = F.col("_p") == F.col("_q")
    for m in marks:
        met = met & F.col(m).eqNullSafe(F.col(f"{m}q"))
    within = Window.partitionBy("_p", *marks).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = named.withColumns({f"_w{k}": F.last(filled[c], ignorenulls=True).over(within) for k, c in enumerate(columns)}).join(starts, met)
    values = {c: F.when(filled[c].isNull(), F.coalesce(F.col(f"_w{k}"), F.col(f"_s{k}"))).otherwise(F.col(c)) for k, c in enumerate(columns)}
    return joined.select(*(values[c].alias(c) if c in values else F.col(c) for c in rows.columns))


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, keys: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """Pairs of rows of equal keys (if any) whose values differ by at most width, bounds included; columns of both sides, keys once.

    Values are cut into buckets of the width: a right row is in its own bucket and in the two beside it, so partners meet
    in the left row's bucket by an equality join. Buckets of more than `most` left rows (and of one in HOT of all rows) are split
    into parts by a hash of the left row, and right rows go to all parts. Null values and null keys have no partners. Names other than the keys must differ.
    """
    keys = keys or []
    by = [*keys, "_bucket"]
    bucket = lambda v: F.floor(F.col(v) / F.lit(width)).cast("bigint")
    a = left.where(F.col(left_value).isNotNull()).withColumn("_bucket", bucket(left_value))
    b = right.where(F.col(right_value).isNotNull()).withColumn("_bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: bucket(right_value) + d)))
    counts = a.groupBy(*by).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    bound = max(most, total // HOT)
    hot = F.broadcast(counts.where(F.col("_n") > bound).select(*by, F.ceil(F.col("_n") / F.lit(bound)).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    a = a.join(hot, by, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int"))
    b = b.join(hot, by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = a.drop("_parts").join(b.drop("_parts"), [*by, "_part"])
    near = F.abs(F.col(left_value) - F.col(right_value)) <= F.lit(width)
    return met.where(near).select(*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys))
