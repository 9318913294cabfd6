"""The query interface: ordered lookups, eligible rows, seat matrix, city filter, summaries, detail panels, search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import no_artifact
from .relational import latest_snapshot


def lookup(rows: DataFrame, column: str, falling: bool = False) -> DataFrame:
    """The distinct values of a column in order."""
    return rows.select(column).distinct().orderBy(F.desc(column) if falling else F.asc(column))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters; an argument that is None doesn't filter, a list keeps any of its values."""
    for column, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(column).isin(list(value))) if value else rows
        elif value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def flagged(rows: DataFrame, name: str = "is_selected", **wanted) -> DataFrame:
    """rows with a flag for those that matching() would keep; nothing is filtered."""
    kept = F.lit(True)
    for column, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            kept = kept & F.col(column).isin(list(value)) if value else kept
        elif value is not None:
            kept = kept & (F.col(column) == value)
    return rows.withColumn(name, F.coalesce(kept, F.lit(False)))


def eligible(cutoffs: DataFrame, institutes: DataFrame, programs: DataFrame, percentile: float, category: str, family: str, ladies: bool = False, year: int | None = None, round_no: int | None = None) -> DataFrame:
    """Rows that a candidate of exactly this category clears, the highest cutoff first, then by institute."""
    rows = matching(cutoffs, base_category=category, is_ladies=ladies, year=year, round=round_no)
    rows = rows.where((F.col("percentile") <= percentile) & no_artifact(F.col("rank_number"), F.col("percentile")))
    joined = rows.join(institutes, "institution_code").join(matching(programs, program_family=family), "program_id")
    out = joined.select("institution_name", "institution_code", "program_name", "year", "round", "stage_code", "section_code", F.col("percentile").alias("cutoff_percentile"), F.col("rank_number").alias("cutoff_rank"))
    return out.orderBy(F.desc("cutoff_percentile"), "institution_name")


def course_rows(cutoffs: DataFrame, institutes: DataFrame, programs: DataFrame, percentile: float, family: str) -> DataFrame:
    """Every row of a family that the percentile clears, of all categories and places."""
    rows = cutoffs.where((F.col("percentile") <= percentile) & no_artifact(F.col("rank_number"), F.col("percentile")))
    joined = rows.join(institutes, "institution_code").join(matching(programs, program_family=family), "program_id")
    return joined.select(*institutes.columns, "program_name", "year", "round", "base_category", "is_ladies", "section_code", "stage_code", F.col("percentile").alias("cutoff_percentile"), F.col("rank_number").alias("cutoff_rank"))


def seat_matrix(seats: DataFrame, institution: str, family: str) -> DataFrame:
    """The latest capture of one institute and family, the printed sum of a lane after its categories."""
    rows = latest_snapshot(matching(seats, institution_code=institution, program_family=family), ["institution_code", "program_family"], "capture_year")
    return rows.select("allocation_lane", "base_category", "is_total", "is_ladies", "seats", "capture_year").orderBy("allocation_lane", "is_total", "base_category")


def in_city(rows: DataFrame, city: str | None) -> DataFrame:
    """Rows whose city holds the text, in any case; a blank text doesn't filter, a null city never matches one."""
    text = (city or "").strip()
    return rows.where(F.lower(F.coalesce("city", F.lit(""))).contains(text.lower())) if text else rows


def summary(rows: DataFrame) -> DataFrame:
    """One row for each institute: its highest cutoff with name, city and site of that row, years and rows; highest first, ties by code.

    An empty input gives an empty table of the same columns.
    """
    best = F.max_by(F.struct("institution_name", "city", "website"), F.struct("cutoff_percentile", "year", "round"))
    each = rows.groupBy("institution_code").agg(best.alias("b"), F.max("cutoff_percentile").alias("highest_cutoff"), F.count_distinct("year").alias("years_on_record"), F.count("*").alias("matching_rows"))
    return each.select("institution_code", "b.*", "highest_cutoff", "years_on_record", "matching_rows").orderBy(F.desc("highest_cutoff"), "institution_code")


def sorted_results(rows: DataFrame, by: str = "percentile") -> DataFrame:
    """summary() in one of three orders: percentile (highest first), name, or seats (most first, none last); ties by code."""
    orders = {"percentile": F.desc("highest_cutoff"), "name": F.asc("institution_name"), "seats": F.desc_nulls_last("seats")}
    return rows.orderBy(orders[by], "institution_code")


def detail(rows: DataFrame, institution: str) -> DataFrame:
    """The panel of one institute: its highest cutoff by year and round, in order."""
    mine = matching(rows, institution_code=institution)
    return mine.groupBy("year", "round").agg(F.max("cutoff_percentile").alias("highest_cutoff")).orderBy("year", "round")


def detail_panel(rows: DataFrame, seats: DataFrame, institution: str, family: str, category: str, ladies: bool = False) -> dict[str, DataFrame]:
    """What the panel of one institute shows of rows that a candidate clears, as tables.

    trend: the highest cutoff of each year and round with its label, in order; table: the rows, the latest first; lanes: the printed sums
    of the latest seat matrix; seats: its rows by category.
    """
    mine = matching(rows, institution_code=institution, base_category=category, is_ladies=ladies)
    label = F.concat(F.col("year").cast("string"), F.lit(" R"), F.col("round").cast("string")).alias("year_round")
    matrix = seat_matrix(seats, institution, family)
    return {
        "trend": mine.groupBy("year", "round").agg(F.max("cutoff_percentile").alias("highest_cutoff")).select(label, "highest_cutoff", "year", "round").orderBy("year", "round"),
        "table": mine.select("year", "round", "stage_code", "section_code", "cutoff_percentile", "cutoff_rank").orderBy(F.desc("year"), F.desc("round"), "stage_code", "section_code", "cutoff_percentile", "cutoff_rank"),
        "lanes": matrix.where("is_total").select("allocation_lane", "seats"),
        "seats": matrix.where(~F.col("is_total")).select("allocation_lane", "base_category", "is_ladies", "seats"),
    }


def raw_rows(cutoffs: DataFrame, programs: DataFrame, family: str, order: list[str]) -> DataFrame:
    """Every cutoff row of a family as delivered, percentiles to seven digits, in the given order."""
    rows = cutoffs.join(matching(programs, program_family=family), "program_id")
    return rows.withColumn("percentile", F.round("percentile", 7)).orderBy(*order)


def search_index(cutoffs: DataFrame, seats: DataFrame, institutes: DataFrame, years: int = 4, category: str = "OPEN") -> DataFrame:
    """One row for each institute and family with cutoffs of the open category that aren't ladies': what the search shows without reading a cutoff.

    history: of the last years the lowest and highest percentile and the rank of the lowest row (the larger rank of ties); cutoff and percentile:
    rank and percentile of the last year's lowest row. seats: the printed sums of the latest capture, null if there are none. years, general and ladies:
    all years, and the categories with their sections, of all cutoffs. Cutoffs are combined once by (institute, family, ladies, year, category, section);
    all else follows from these rows.
    """
    keys = ["institution_code", "program_family"]
    fine = cutoffs.where(no_artifact(F.col("rank_number"), F.col("percentile")))
    by_rank = F.coalesce(-F.col("rank_number"), F.lit((1 << 31) - 1))  # a missing rank comes last
    lowest = F.min(F.struct(F.col("percentile").alias("low"), by_rank.alias("order"), F.col("rank_number").alias("rank")))
    base = fine.groupBy(*keys, "is_ladies", "year", "base_category", "section_code").agg(lowest.alias("l"), F.max("percentile").alias("high"))
    yearly = base.where((F.col("base_category") == category) & ~F.col("is_ladies")).groupBy(*keys, "year").agg(F.min("l").alias("l"), F.max("high").alias("high"))
    each = F.struct("year", F.col("l.low").alias("low"), "high", F.col("l.rank").alias("rank"))
    history = yearly.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(each), asc=False), 1, years).alias("h")).withColumn("history", F.reverse("h"))
    sections = base.groupBy(*keys, "is_ladies", "base_category").agg(F.sort_array(F.collect_set("section_code")).alias("sections"), F.collect_set("year").alias("ys"))
    option = F.struct(F.col("base_category").alias("category"), "sections")
    options = sections.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ys")))).alias("years"),
        *(F.sort_array(F.collect_list(F.when(F.col("is_ladies") == which, option))).alias(name) for which, name in ((False, "general"), (True, "ladies"))),
    )
    top = latest_snapshot(seats, keys, "capture_year").where("is_total").groupBy(*keys).agg(F.sum("seats").alias("seats"))
    latest = F.col("h")[0]
    out = history.join(options, keys).join(top, keys, "left").join(institutes, "institution_code")
    return out.select(*institutes.columns, "program_family", latest["rank"].alias("cutoff"), latest["low"].alias("percentile"), "seats", "history", "years", "general", "ladies")


def year_extremes(rows: DataFrame, keys: list[str], year: str, low: str, high: str) -> DataFrame:
    """Highest and lowest over all years with their year, the earliest of ties."""
    return rows.groupBy(*keys).agg(F.max(high).alias("highest"), F.max_by(year, F.struct(F.col(high), -F.col(year))).alias("highest_year"), F.min(low).alias("lowest"), F.min_by(year, F.struct(F.col(low), F.col(year))).alias("lowest_year"))


def latest_rounds(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Closing value of each round of the latest year of each key."""
    low = rows.groupBy(*keys, "year", "round").agg(F.min(value).alias("closing"))
    return latest_snapshot(low, keys, "year")


def chosen_range(rows: DataFrame, keys: list[str], value: str, chosen: str = "is_selected") -> DataFrame:
    """Of each key the lowest and highest value and the number of the rows that are chosen; null, null and 0 where none is."""
    own = F.when(F.col(chosen), F.col(value))
    return rows.groupBy(*keys).agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count_if(chosen).alias("n"))


def closing_points(cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key, year and round the closing percentile (to four digits) and rank; stages of a round are one point."""
    fine = cutoffs.where(no_artifact(F.col("rank_number"), F.col("percentile")))
    return fine.groupBy(*keys, "year", "round").agg(F.round(F.min("percentile"), 4).alias("percentile"), F.max("rank_number").alias("rank"))


def round_series(points: DataFrame, keys: list[str], value: str = "percentile") -> DataFrame:
    """One series for each key and round: its points by year, only those that exist."""
    return points.groupBy(*keys, "round").agg(F.sort_array(F.collect_list(F.struct("year", F.col(value).alias("value")))).alias("series"))


def selection(rows: DataFrame, low: float, high: float, value: str, chosen: Column, enough: int, keys: list[str]) -> DataFrame:
    """Of each key: rows within the range, those that are selected, and whether the data are limited."""
    inside = F.col(value).between(low, high)
    return rows.groupBy(*keys).agg(F.count_if(inside).alias("inside"), F.count_if(inside & chosen).alias("selected"), (F.count("*") < enough).alias("limited"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows there are, and how many have each column."""
    return rows.agg(F.count("*").alias("total"), *(F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(f"with_{c}") for c in columns))
