"""Small states that merge: stored aggregates by partition, first examples of each kind, subtotals, event logs."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.workspace import kept
from .relational import numbered

#: Tasks whose states of one kind are merged together before the last step.
FAN = 64


def refresh(path: str, batch: DataFrame, keys: list[str], partition: str, low: dict[str, str], high: dict[str, str]) -> DataFrame | None:
    """Merges a batch into stored minima (low: state -> column) and maxima (high) by keys, and rewrites only the partitions that it touches.

    path holds keys and states by directories of the partition column, which is one of the keys; it need not exist. The batch is combined first,
    stored states of its partitions are read (others are pruned), merged and written aside, and then replace these
    partitions. Minima and maxima of a batch that is merged again don't change, so a load that broke off is just repeated. Returns
    the stored table, None if there is none yet.
    """
    spark = batch.sparkSession
    states = [*(F.min(c).alias(s) for s, c in low.items()), *(F.max(c).alias(s) for s, c in high.items())]
    again = [*(F.min(s).alias(s) for s in low), *(F.max(s).alias(s) for s in high)]
    new = kept(batch.groupBy(*keys).agg(*states), "states")
    touched = new.select(partition).distinct()
    stored = _stored(spark, path)
    if stored is not None:
        met = F.col(f"_o.{partition}").eqNullSafe(F.col(f"_t.{partition}"))
        old = stored.alias("_o").join(F.broadcast(touched.alias("_t")) if touched.count() <= 10_000 else touched.alias("_t"), met, "left_semi").select(*new.columns)
        new = kept(new.unionByName(old).groupBy(*keys).agg(*again), "states")
    if stored is None or not touched.isEmpty():
        new.repartition(partition, F.pmod(F.xxhash64(*keys), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return _stored(spark, path)


def _stored(spark, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else None


def _least(t: pa.Table, kind: str, order: list[str], n: int) -> pa.Table:
    """The first n rows of each kind by the order, sorted."""
    t = t.sort_by([(c, "ascending") for c in (kind, *order)])
    if not t.num_rows:
        return t
    k = t.column(kind).combine_chunks()
    k = k.chunk(0) if isinstance(k, pa.ChunkedArray) else k
    code = pc.dictionary_encode(k.fill_null("")).indices.to_numpy(zero_copy_only=False)
    null = k.is_null().to_numpy(zero_copy_only=False)
    fresh = [True, *((code[1:] != code[:-1]) | (null[1:] != null[:-1])).tolist()]
    place, keep_row = 0, []
    for f in fresh:
        place = 0 if f else place + 1
        keep_row.append(place < n)
    return t.filter(pa.array(keep_row))


def first_examples(rows: DataFrame, kind: str, order: list[str], n: int = 100) -> DataFrame:
    """The first n rows of each kind (a string, null is one too) by the order columns, with example, their place from 1.

    A state holds n rows a kind. Each task merges its batches into one state, states of FAN tasks are merged next, and only
    these, FAN * n rows a kind, are ranked; no task sorts or receives all rows of a kind. Nulls of the order come last.
    """

    def state(iterator):
        held = None
        for b in iterator:
            t = pa.Table.from_batches([b])
            held = _least(t if held is None else pa.concat_tables([held, t]), kind, order, n)
        if held is not None:
            yield from held.to_batches()

    once = rows.mapInArrow(state, rows.schema)
    merged = once.repartition(F.col(kind), F.pmod(F.spark_partition_id(), F.lit(FAN))).mapInArrow(state, rows.schema)
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*(F.asc_nulls_last(c) for c in order)))
    return merged.withColumn("example", place).where(F.col("example") <= n)


def with_totals(rows: DataFrame, keys: list[str], part: str, value: Column) -> DataFrame:
    """keys, part, value and is_total: the sums of each part and, with a null part, of the keys, in one pass."""
    level = rows.withColumn("_v", value).groupingSets([[F.col(c) for c in (*keys, part)], [F.col(c) for c in keys]], *(F.col(c) for c in (*keys, part)))
    return level.agg(F.sum("_v").alias("value"), (F.grouping(part) == 1).alias("is_total"))


def append_events(path: str, batch: DataFrame, event: str, order: list[str], number: str = "sequence") -> DataFrame:
    """Appends the events of batch that the log at path lacks, numbered on from its highest number in the order given; returns the log.

    An event is known by its id: appending a batch twice adds nothing, and of equal ids in a batch the first by order stays. Rows without an id are refused.
    """
    spark = batch.sparkSession
    if not batch.where(F.col(event).isNull()).isEmpty():
        raise ValueError(f"events without {event}")
    first = F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("e")
    new = batch.groupBy(F.col(event).alias("_id")).agg(first).select("e.*")
    log, top = _stored(spark, path), 0
    if log is not None:
        new = new.join(log.select(event), event, "left_anti")
        top = log.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
    fresh = numbered(new, [*order, event], "_n").select(*batch.columns, (F.lit(top) + F.col("_n")).cast(LongType()).alias(number))
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)
