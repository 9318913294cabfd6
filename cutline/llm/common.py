"""Shared plumbing: the shared work folder, worker paths, table reading, bounded Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python task; whole texts are long, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20
#: Environment of Python workers: what a batch frees goes back to the system, as workers outlive tasks beside the JVM's memory.
FREED = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and workers' freed memory, and lets workers import this package from where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env = spark.sparkContext.environment
    for name, value in FREED.items():
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = ROOT + (os.pathsep + have if have else "")
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-cutline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    path = f"{shared_base(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)
    return path


def keep(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
