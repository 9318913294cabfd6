"""Names of institutes: the canonical one of each code, and contacts from a list of other origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from .relational import append_absent, update_matched

CODE, NAME = "institution_code", "institution_name"


def canonical_names(rows: DataFrame, year: str = "year") -> dict[str, DataFrame]:
    """names: for each code its most frequent name of the latest year (the first in the alphabet of ties), that year, and how many names it has;
    variants: the other names with their number of rows over all years. Rows with a blank code or name don't count.

    Rows are combined by (code, year, name) before anything else.
    """
    trimmed = rows.select(F.trim(CODE).alias(CODE), F.trim(NAME).alias(NAME), year).where(f"{CODE} <> '' and {NAME} <> ''")
    each = trimmed.groupBy(CODE, NAME, year).agg(F.count("*").alias("n"))
    spread = each.groupBy(CODE, NAME).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col(year)).alias("y"), (-F.col("n")).alias("m"), F.col(NAME).alias("name"))).alias("b"))
    names = spread.groupBy(CODE).agg(F.min("b").alias("b"), F.count("*").alias("variants"))
    names = names.select(CODE, F.col("b.name").alias(NAME), (-F.col("b.y")).alias(year), "variants")
    variants = spread.select(CODE, NAME, "n").join(names.select(CODE, NAME), [CODE, NAME], "left_anti")
    return {"names": names, "variants": variants}


def with_names(institutes: DataFrame, names: DataFrame) -> DataFrame:
    """institutes in which known codes take their canonical name and keep all else, and codes that it lacks are added."""
    fresh = names.select(*(F.col(f.name) if f.name in (CODE, NAME) else F.lit(None).cast(f.dataType).alias(f.name) for f in institutes.schema))
    return append_absent(update_matched(institutes, names.select(CODE, NAME), [CODE], [NAME]), fresh, [CODE])


def contacts(institutes: DataFrame, listed: DataFrame, order: str, least: float = fields.LEAST_RATIO) -> dict[str, DataFrame]:
    """Cities and websites of a list (codes, name, city, website; several codes in one cell, parted by commas) for the institutes.

    institutes: with city and website of the codes that passed; the others keep theirs. quarantined: code, reason and detail of the rest, in this order:
    CITY_CONFLICT (several cities), CODE_NOT_IN_DB, NAME_MISMATCH (the two names, normalised, are less alike than `least`). Of several rows
    of a code the first with a website counts, else the first; a website 'unknown' is none. A blank code is a code like any other.
    """
    site = F.trim("website")
    rows = listed.select(
        F.posexplode(F.split("codes", ",")).alias("_k", "_c"), F.trim("name").alias("name"), F.trim("city").alias("city"),
        F.when((F.lower(site) != "unknown") & (site != ""), site).alias("site"), F.col(order).alias("_o"),
    ).withColumn(CODE, F.trim("_c"))
    place = F.struct("_o", "_k")
    best = F.min(F.struct(F.col("site").isNull().alias("_none"), place.alias("_at"), "site", "name", "city"))
    cities = rows.groupBy(CODE, "city").agg(best.alias("b"), F.max_by("name", place).alias("name"))
    each = cities.groupBy(CODE).agg(F.min("b").alias("b"), F.count("city").alias("_cities"), F.sort_array(F.collect_list(F.struct("city", "name"))).alias("_names"))
    found = each.join(institutes.select(CODE, F.col(NAME).alias("_known")), CODE, "left")
    ratio = fields.name_ratio(fields.normal_name(F.col("_known")), fields.normal_name(F.col("b.name")))
    judged = found.withColumn("_ratio", ratio)
    reason = F.when(F.col("_cities") > 1, "CITY_CONFLICT").when(F.col("_known").isNull(), "CODE_NOT_IN_DB").when(F.col("_ratio") < least, "NAME_MISMATCH")
    conflict = F.array_join(F.transform("_names", lambda x: F.concat_ws("=", x["city"], x["name"])), "; ")
    mismatch = F.concat(F.col("_known"), F.lit(" / "), F.col("b.name"))
    detail = F.when(F.col("reason") == "CITY_CONFLICT", conflict).when(F.col("reason") == "NAME_MISMATCH", mismatch).otherwise(F.col("b.name"))
    judged = judged.withColumn("reason", reason)
    clean = judged.where("reason is null").select(CODE, F.col("b.city").alias("city"), F.col("b.site").alias("website"))
    return {
        "institutes": update_matched(institutes, clean, [CODE], ["city", "website"]),
        "quarantined": judged.where("reason is not null").select(CODE, "reason", detail.alias("detail")),
    }
