"""Column functions on coded fields; blank is '' and unknown is null."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Codes that stand for themselves, with their base code.
WHOLE_CODES = {"MI": "MI", "MI-MH": "MI", "EWS": "EWS", "TFWS": "TFWS"}
ORPHAN_CODES = {"ORPHAN": "ORPHAN", "ORPINST": "ORPHAN_INST", "ORPHANI": "ORPHAN_INST", "ORPNONINST": "ORPHAN_NONINST", "ORPHANN": "ORPHAN_NONINST"}
# The last letter of a code and the section it means.
SECTION_SUFFIX = {"H": "HU", "O": "OHU", "S": "SL"}


def decompose_category(raw: Column) -> Column:
    """struct(base, ladies, section) of a coded category; null where it can't be one."""
    def parts(code: Column) -> Column:
        whole = F.try_element_at(F.create_map(*(F.lit(x) for kv in {**WHOLE_CODES, **ORPHAN_CODES}.items() for x in kv)), code)
        tail = F.regexp_extract(code, "([HOS])$", 1)
        section = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SECTION_SUFFIX.items() for x in kv)), tail), F.lit("SL"))
        base = F.regexp_replace(code, "^[LG]|[HOS]$", "")
        ladies = code.startswith("L") & (F.length(code) > F.length(tail))
        parsed = F.struct(base.alias("base"), ladies.alias("ladies"), section.alias("section"))
        return F.when(whole.isNotNull(), F.struct(whole.alias("base"), F.lit(False).alias("ladies"), F.lit("SL").alias("section"))).when(base != "", parsed)

    # As the one element of an array the code is a variable of the lambda, computed once.
    return F.element_at(F.transform(F.array(F.upper(F.trim(raw))), parts), 1)


def zero_filled(x: Column, size: int = 5) -> Column:
    """Left zeros up to size; longer values stay whole."""
    return F.when(F.length(x) >= size, x).otherwise(F.lpad(x, size, "0"))


def safe_int(x: Column) -> Column:
    """Digits only, else null."""
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))


#: A number as delivered files write it; neither NaN, Infinity nor a type's letter belongs to it.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def safe_double(x: Column) -> Column:
    """A number, else null."""
    return F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))


def json_merge(left: Column, right: Column) -> Column:
    """The union of two JSON objects by key; the right one wins, null values stay, numbers keep their digits. Null or no object counts as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    a, b = (F.coalesce(F.from_json(x, "map<string,variant>"), empty) for x in (left, right))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b))


def no_artifact(rank: Column, score: Column) -> Column:
    """Leaves out rank 0 with score 0.0; three-valued, as NOT (a AND b)."""
    return ~((rank == 0) & (score == 0.0))


def mapped(x: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """Vocabulary lookup of a small fixed map; the default (null, if none) where it isn't listed."""
    found = F.try_element_at(F.create_map(*(F.lit(t) for pair in names.items() for t in pair)), x)
    return found if default is None else F.coalesce(found, default)


# The least ratio of two names that count as one institution, and numerals that are no category.
LEAST_RATIO = 0.30
NUMERALS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]


def chance_badge(diff: Column) -> Column:
    """Above 3 high, 1 to 3 good, 0 to 1 fair (the lower bound belongs to a band), else low; null stays null."""
    return F.when(diff > 3, "high").when(diff >= 1, "good").when(diff >= 0, "fair").when(diff < 0, "low")


def status_band(diff: Column) -> Column:
    return F.when(diff >= 1, "safe").when(diff >= -1, "borderline").when(diff < -1, "reach")


def ordinal(x: Column, names: list[str]) -> Column:
    """Place in a fixed list, from 1; values that aren't listed, and null, come last."""
    place = F.array_position(F.array(*map(F.lit, names)), x)
    return F.when(place > 0, place).otherwise(len(names) + 1).cast("int")


def normal_name(x: Column) -> Column:
    """Upper case; everything else than letters A-Z and digits is one blank."""
    return F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " "))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two names; null where one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def text_lines(x: Column) -> Column:
    """The lines of a text that aren't blank, trimmed, with runs of blanks as one."""
    t = F.translate(F.coalesce(x, F.lit("")), "\0", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t]+", " ")
    lines = F.transform(F.split(F.regexp_replace(t, "\n{3,}", "\n\n"), "\n"), lambda s: F.regexp_replace(s, "^[ \t\r\f]+|[ \t\r\f]+$", ""))
    return F.filter(lines, lambda s: s != "")


def is_category_line(line: Column) -> Column:
    """Every token of the line is an upper-case letter and 1 to 14 more, digits or hyphens, and no numeral or STAGE."""
    return F.forall(F.split(line, " "), lambda t: t.rlike("^[A-Z][A-Z0-9-]{1,14}$") & ~t.isin(*NUMERALS, "STAGE"))


def ranked_values(line: Column) -> Column:
    """Array of struct(rnk, letter, pct) of each 'rank[letter] (percentage)' of a line; a rank has at most six digits."""
    found = F.regexp_extract_all(line, F.lit(r"[0-9]{1,6}[A-Za-z]?\s*\([0-9]+(?:\.[0-9]+)?\)"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, "^([0-9]+)", 1).try_cast("bigint").alias("rnk"), F.regexp_extract(m, "^[0-9]+([A-Za-z]?)", 1).alias("letter"), F.regexp_extract(m, r"\(([0-9.]+)\)", 1).try_cast("double").alias("pct")))
