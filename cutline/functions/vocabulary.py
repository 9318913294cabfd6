"""Vocabularies of the delivered files, and column functions on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import mapped, zero_filled

# Stages in both spellings, and the blank one.
STAGES = {
    "Stage-I": "Stage-I", "Stage I": "Stage-I", "Stage-II": "Stage-II", "Stage II": "Stage-II", "Stage-III": "Stage-III", "Stage III": "Stage-III",
    "Stage-IV": "Stage-IV", "Stage IV": "Stage-IV", "Stage-V": "Stage-V", "Stage V": "Stage-V", "Stage-VI": "Stage-VI", "Stage VI": "Stage-VI",
    "Stage-VII": "Stage-VII", "Stage VII": "Stage-VII", "Stage-MI": "Stage-MI", "Stage MI": "Stage-MI", "": "Unknown",
}
# Headings of sections and their codes.
SECTIONS = {
    "Home University Seats Allotted to Home University Candidates": "HU",
    "Other Than Home University Seats Allotted to Other Than Home University Candidates": "OHU",
    "Home University Seats Allotted to Other Than Home University Candidates": "HU_TO_OHU",
    "Other Than Home University Seats Allotted to Home University Candidates": "OHU_TO_HU",
    "State Level": "SL",
    "Minority Seats : Minority Seats Allotted to Minority Candidates": "MI-MIN",
    "Minority Seats : Minority Seats Allotted to Non Minority Candidates": "MI-NONMIN",
}
# Patterns of heading lines, of a stage's mark within a line, and of a number in a cell.
INSTITUTE_LINE, PROGRAM_LINE = r"^\s*([0-9]{3,5})\s*-\s*(.+?)\s*$", r"^\s*([0-9]{7,12}[Ff]?)\s*-\s*(.+?)\s*$"
STATUS_LINE, UNIVERSITY_LINE = r"(?i)^\s*Status\s*:\s*(.+?)\s*$", r"(?i)^\s*Home University\s*:\s*(.+?)\s*$"
STAGE_MARK = r"(?i)Stage[-\s]*[IVXLCDM]+"
NUMBER_CELL = r"^-?[0-9]+(\.[0-9]+)?$"
# Texts in the category cell that are no category, a spelling of one, the row of a lane's printed sum.
NO_CATEGORIES = ["GOVERNMENT"]
CATEGORY_ALIASES = {"VJDT": "VJ/DT"}
TOTAL = "Total"


def stage(x: Column) -> Column:
    return mapped(F.trim(x), STAGES)


def section(x: Column) -> Column:
    return mapped(F.trim(x), SECTIONS)


def category_alias(x: Column) -> Column:
    return mapped(x, CATEGORY_ALIASES, x)


def gender(x: Column) -> Column:
    """G false, L true, anything else null."""
    return F.when(F.trim(x) == "G", False).when(F.trim(x) == "L", True)


def anomaly(code: Column, name: Column, category: Column) -> Column:
    """A row without institution, or whose category cell holds a text known to be none."""
    blank = (F.trim(F.coalesce(code, F.lit(""))) == "") & (F.trim(F.coalesce(name, F.lit(""))) == "")
    return blank | F.upper(F.trim(F.coalesce(category, F.lit("")))).isin(NO_CATEGORIES)


def institution_code(code: Column, choice: Column) -> Column:
    """struct(code, ok): the first five characters of the choice code; ok unless the code column is filled and differs when zero-padded."""
    short = F.substring(choice, 1, 5)
    own = F.trim(F.coalesce(code, F.lit("")))
    return F.struct(short.alias("code"), ((own == "") | (zero_filled(own) == short)).alias("ok"))


def whole_number(x: Column) -> Column:
    """The strict integer of the loader: blanks around it and a sign are allowed, a decimal point isn't."""
    t = F.trim(x)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))


def loose_integer(x: Column) -> Column:
    """A number cut toward zero, else null."""
    return F.trim(x).try_cast("double").try_cast("int")


def rounded(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def clamped(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def shown(x: Column, digits: int = 2) -> Column:
    """A number with at most so many decimals, without zeros at their end."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x.cast("double")), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def slug(x: Column, default: str = "field") -> Column:
    """Lower case, anything but letters and digits as one underscore; the default where nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name == "", default).otherwise(name)


def slugs(labels: Column, default: str = "field") -> Column:
    """The slugs of an array of labels; the second of equal ones gets _2, the third _3, and so on."""
    names = F.transform(labels, lambda x: slug(F.coalesce(x, F.lit("")), default))
    # As the one element of an array the names are a variable of the lambda, made once.
    def numbered(all_names: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = F.size(F.filter(F.slice(all_names, 1, i + 1), lambda y: y == x))
            return F.when(n == 1, x).otherwise(F.concat(x, F.lit("_"), n.cast("string")))

        return F.transform(all_names, one)

    return F.element_at(F.transform(F.array(names), numbered), 1)


def artifact_name(family: Column, year: Column, number: Column) -> Column:
    """The name of a cutoff file; of a seat file where there is no year."""
    return F.when(year.isNull(), F.concat(F.upper(family), F.lit("_SM.csv"))).otherwise(F.format_string("%s_%02d_C%d_cutoffs.csv", F.upper(family), year % 100, number))


def labelled_number(line: Column, label: str) -> Column:
    """The number after a label in any case, with or without a colon, else null. The label is text, no pattern."""
    return F.nullif(F.regexp_extract(line, rf"(?i)\Q{label}\E\s*:?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def headings(line: Column) -> Column:
    """struct(institute, institute_name, program, program_name, status, university) of a heading line; null where it is none of them. Institute codes have five digits."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    return F.struct(
        zero_filled(part(INSTITUTE_LINE, 1)).alias("institute"), part(INSTITUTE_LINE, 2).alias("institute_name"), part(PROGRAM_LINE, 1).alias("program"), part(PROGRAM_LINE, 2).alias("program_name"),
        part(STATUS_LINE, 1).alias("status"), part(UNIVERSITY_LINE, 1).alias("university"),
    )


def page_headings(lines: Column) -> Column:
    """headings() of a page: of each field the first line that gives it."""
    found = F.transform(lines, headings)
    first = lambda field: F.try_element_at(F.filter(F.transform(found, lambda h: h[field]), lambda v: v.isNotNull()), F.lit(1))
    with_line = lambda field: F.try_element_at(F.filter(found, lambda h: h[field].isNotNull()), F.lit(1))
    return F.struct(
        first("institute").alias("institute"), with_line("institute")["institute_name"].alias("institute_name"), first("program").alias("program"), with_line("program")["program_name"].alias("program_name"),
        first("status").alias("status"), first("university").alias("university"),
    )


def detected_section(line: Column) -> Column:
    """The code of the section that a line names: a whole heading in any case and spacing, else the longest heading that the line holds, else what a line on minority seats or on the state level says; null if none."""
    text = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    out = mapped(text, {k.lower(): v for k, v in SECTIONS.items()})
    for name in sorted(SECTIONS, key=len, reverse=True):
        out = F.coalesce(out, F.when(text.contains(name.lower()) if name != "State Level" else text.startswith(name.lower()), SECTIONS[name]))
    minority = text.contains("minority seats")
    rest = F.when(minority & text.contains("non minority"), "MI-NONMIN").when(minority & text.contains("minority candidates"), "MI-MIN")
    return F.coalesce(out, rest)


def stage_parts(line: Column) -> Column:
    """Array of struct(stage, rest): the marks of stages in a line and what follows each; what stands before the first has no mark."""
    pieces = F.split(line, rf"{STAGE_MARK[:4]}(?={STAGE_MARK[4:]})")
    parted = F.transform(pieces, lambda s: F.struct(F.regexp_extract(s, f"{STAGE_MARK[:4]}^{STAGE_MARK[4:]}", 0).alias("stage"), F.trim(F.regexp_replace(s, f"{STAGE_MARK[:4]}^{STAGE_MARK[4:]}", "")).alias("rest")))
    return F.filter(parted, lambda p: (p["stage"] != "") | (p["rest"] != "") | (F.size(pieces) == 1))


def row_numbers(cells: Column, count: int) -> Column:
    """The numbers among the cells of a row, signs and decimals included; null where there aren't so many."""
    clean = F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    numbers = F.filter(clean, lambda c: c.rlike(NUMBER_CELL))
    return F.when(F.size(numbers) == count, F.transform(numbers, lambda c: c.try_cast("double")))


def numeric_cells(line: Column, count: int) -> Column:
    """row_numbers() of a line whose cells blanks part."""
    return row_numbers(F.split(F.trim(line), r"\s+"), count)


def merged_lines(lines: Column) -> Column:
    """A percentage alone on its line joins the rank line before it."""

    def step(state: Column, line: Column) -> Column:
        joins = line.rlike(r"^\(\s*[0-9]+(?:\.[0-9]+)?\s*\)$") & F.coalesce(F.try_element_at(state, F.lit(-1)), F.lit("")).rlike("[0-9][A-Za-z]?$")
        return F.when(joins, F.concat(F.slice(state, 1, F.greatest(F.lit(0), F.size(state) - 1)), F.array(F.concat_ws(" ", F.try_element_at(state, F.lit(-1)), line)))).otherwise(F.concat(state, F.array(line)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)
