"""Releases of a set of tables: all of them change at once, or none.

Each release writes its tables below root/versions/<id>. A pointer file, root/pointers/<number>, names the release that
readers see; it is written aside and renamed into place last, and the pointer with the highest number holds. A rename onto a number
that is taken fails, so of two concurrent promotions one is refused. Rolling back points to an older release; nothing is
rewritten. Whatever fails before the rename leaves readers where they were, and its files are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class PromotionError(RuntimeError):
    """The release was refused; the tables are as before."""


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Number and path of the pointers, in order."""
    fs, folder = _system(spark, f"{root}/pointers")
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    return sorted((int(p.getName()), p.toString()) for p in names if p.getName().isdigit())


def history(spark: SparkSession, root: str) -> list[dict]:
    """What the pointers say, oldest first: number, version, action and tables."""
    out = []
    for number, path in _pointers(spark, root):
        fs, p = _system(spark, path)
        stream = fs.open(p)
        try:
            out.append({"number": number, **json.loads(bytes(stream.readAllBytes()).decode())})
        finally:
            stream.close()
    return out


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers see; None before the first."""
    pointers = history(spark, root)
    return pointers[-1]["version"] if pointers else None


def _point(spark: SparkSession, root: str, version: str, action: str, tables: list[str], number: int) -> None:
    fs, aside = _system(spark, f"{root}/pointers/.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps({"version": version, "action": action, "tables": sorted(tables)}).encode()))
    stream.close()
    target = _path(spark, f"{root}/pointers/{number:012d}")
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise PromotionError("another release was promoted meanwhile")


def promote(spark: SparkSession, root: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> str:
    """Writes the tables as a new release and makes it the one that readers see; gives its name.

    check gets the tables as written and returns rows that speak against them; if there is any, the release is refused.
    Tables of the current release that aren't given stay in it as they are.
    """
    number = (_pointers(spark, root) or [(0, "")])[-1][0] + 1
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{version}"
    fs, path = _system(spark, folder)
    try:
        written = {}
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}")
            written[name] = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
        if check is not None and (found := check(written).limit(5).collect()):
            raise PromotionError(f"{version} is refused: {found}")
        places = _places(spark, root, current(spark, root)) | {name: version for name in tables}
        stream = fs.create(_path(spark, f"{folder}/tables.json"), True)
        stream.write(bytearray(json.dumps(places).encode()))
        stream.close()
        _point(spark, root, version, "promote", list(tables), number)
    except Exception:
        fs.delete(path, True)
        raise
    return version


def _places(spark: SparkSession, root: str, version: str | None) -> dict[str, str]:
    """The tables of a release, and the version whose files each has."""
    if version is None:
        return {}
    fs, p = _system(spark, f"{root}/versions/{version}/tables.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of the current release, or of the one named."""
    version = version or current(spark, root)
    place = _places(spark, root, version).get(table)
    if place is None:
        raise FileNotFoundError(f"no table {table} in {root}, release {version}")
    return spark.read.parquet(f"{root}/versions/{place}/{table}")


def rollback(spark: SparkSession, root: str, version: str | None = None) -> str:
    """Points readers to an older release: the one named, else the one that was current before the current one was promoted."""
    steps = history(spark, root)
    if not steps:
        raise PromotionError("there is no release")
    now, seen = steps[-1]["version"], [s["version"] for s in steps if s["action"] == "promote"]
    if version is None:
        at = seen.index(now)
        if at == 0:
            raise PromotionError(f"{now} is the first release")
        version = seen[at - 1]
    elif version not in seen:
        raise PromotionError(f"no release {version}")
    _point(spark, root, version, "rollback", [], steps[-1]["number"] + 1)
    return version
