"""Fiscal periods (April to March) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shapes a period label may have, the whole string at most 30 characters long.
STRICT_PERIOD = (
    r"(?i)^\(?\s*(q[1-4]\s?['’]?(fy)?\s?\d{2,4}|fy\s?['’]?\d{2,4}|\d{1,2}\s?[\-/.]\s?[a-z]{3,9}\.?\s?['’]?[\-/.]?\s?\d{2,4}|\d{1,2}\s?[\-/.]\s?\d{1,2}\s?[\-/.]\s?\d{2,4}"
    r"|[a-z]{3,9}\.?\s+\d{1,2},?\s+\d{2,4}|(year|quarter)\s?(ended|end)?\s.{0,20}?\d{2,4}|as\s+(at|on)\s.{0,20}?\d{2,4}|(un)?audited|restated)\s*\)?$"
)
# A longer window than a quarter, the year before, a column placeholder, dates and quarters in labels.
OTHER_WINDOW = r"(?i)\b(half.?year|nine.?months?|year ended|annual|twelve.?months?|6.?months?|six.?months?|9.?months?|12.?months?)\b"
PRIOR_YEAR = r"(?i)\b(previous year|prior year|year ago|last year)\b|corresponding.{0,20}(previous|prior|last)"
PLACEHOLDER = r"(?i)^\s*col(?:umn)?[_\s]?\d+\s*$"
FY_DIGITS = r"(?i)\bFY\s*'?(\d+)\b"
NAMED_DATE = r"(?i)\b(?:(\d{1,2})\s*[-/ ]\s*)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*[-/ ,]\s*(?:(\d{1,2})\s*[-/ ,]\s*)?(\d{4})\b"
SLASHED_DATE = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
RUN_ON_DATE = r"\b(\d{2})(\d{2})(\d{4})\b"
QUARTER_LABEL = r"(?i)\b(Q[1-4])\s*FY\s*(\d{2}|\d{4})\b"
# What a question says of the periods it is about.
ASKED_PERIOD = r"(?i)\bQ([1-4])\s*FY\s*(\d{2,4})\b"
ASKED_YEAR = r"(?i)\bFY\s*(\d{2,4})\b"
WIDE_TREND = r"(?i)\b(trend(?:ed)?|over the (?:full|past|last|entire)|three.?year|3.?year|multi.?year|full period|entire period)\b"
QOQ = r"(?i)\bquarter[\s-]on[\s-]quarter\b|\bquarter[\s-]over[\s-]quarter\b|\bqoq\b|\bsequential(?:ly)?\b"
YOY = r"(?i)\byear[\s-]on[\s-]year\b|\byear[\s-]over[\s-]year\b|\byoy\b"
EVERY_QUARTER = r"(?i)\b(highest|lowest|trend|across|full three-year|full three year|full two-year|full two year|all quarters|quarterly figures|peak|quarter recorded|two different quarters|different quarters)\b"
WHOLE_YEAR = r"(?i)\b(annual|yearly|fiscal year|year-on-year revenue growth|strongest year-on-year)\b"
NO_QUARTER = ("FY-FULL", "FY", "FULL", "ALL", "ANNUAL", "")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def fiscal_quarter(date: Column) -> Column:
    """1 for April to June ... 4 for January to March."""
    return F.quarter(F.add_months(date, -3))


def fiscal_year(date: Column) -> Column:
    """The calendar year in which the fiscal year ends."""
    return F.year(F.add_months(date, 9))


def quarter_index(label: Column) -> Column:
    """1 to 4 for Q1 to Q4; other labels sort after them."""
    return F.coalesce(F.regexp_extract(F.upper(label), "^Q([1-4])$", 1).try_cast("int"), F.lit(5))


def sort_year(year: Column) -> Column:
    """The year as a number; 0 where it is none."""
    return F.coalesce(year.try_cast("int"), F.lit(0))


def shift(fy: Column, q: Column, by: int) -> tuple[Column, Column]:
    """(year, quarter) ``by`` quarters later."""
    at = fy * 4 + (q - 1) + by
    return F.floor(at / 4).cast("int"), (F.pmod(at, F.lit(4)) + 1).cast("int")


def change_type(y0: Column, q0: Column, y1: Column, q1: Column) -> Column:
    """QoQ within a fiscal year, YoY for the same quarter a year on, else sequential."""
    return F.when((y1 == y0) & (q1 == q0 + 1), "QoQ").when((y1 == y0 + 1) & (q1 == q0), "YoY").otherwise("sequential")


def looks_like_period(text: Column) -> Column:
    flat = F.trim(F.coalesce(text, F.lit("")))
    return (flat != "") & (F.length(flat) <= 30) & flat.rlike(STRICT_PERIOD)


def bad_label(text: Column) -> Column:
    """A column placeholder, or a fiscal year with neither two nor four digits."""
    flat = F.coalesce(text, F.lit(""))
    return flat.rlike(PLACEHOLDER) | F.exists(F.regexp_extract_all(flat, F.lit(FY_DIGITS), 1), lambda x: ~F.length(x).isin(2, 4))


def window_mismatch(quarter: Column, text: Column) -> Column:
    """A quarter's row whose label names a longer window or the year before."""
    flat = F.coalesce(text, F.lit(""))
    return F.upper(F.coalesce(quarter, F.lit(""))).isin("Q1", "Q2", "Q3", "Q4") & (flat.rlike(OTHER_WINDOW) | flat.rlike(PRIOR_YEAR))


def long_year(digits: Column) -> Column:
    """A fiscal year of two digits in this century; others as they are."""
    return F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(digits).try_cast("int")


def parse_label(text: Column) -> Column:
    """struct(fq, fy) of a quarter label or, failing that, of a date: named, slashed or run together; nulls where it has none."""
    flat = F.coalesce(text, F.lit(""))
    part = lambda pattern, i: F.regexp_extract(flat, pattern, i)
    fq = F.substring(part(QUARTER_LABEL, 1), 2, 1).try_cast("int")
    first = lambda: F.make_date(part(NAMED_DATE, 4).try_cast("int"), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(NAMED_DATE, 2))).cast("int"), F.lit(1))
    date = F.when(part(NAMED_DATE, 2) != "", first())
    for pattern in (SLASHED_DATE, RUN_ON_DATE):
        d, m, y = (part(pattern, i).try_cast("int") for i in (1, 2, 3))
        date = F.coalesce(date, F.when(m.between(1, 12) & d.between(1, 31) & y.between(1990, 2100), F.make_date(y, m, F.lit(1))))
    fy = long_year(F.nullif(part(QUARTER_LABEL, 2), F.lit("")))
    return F.struct(F.coalesce(fq, fiscal_quarter(date)).alias("fq"), F.coalesce(fy, fiscal_year(date)).alias("fy"))


def contradicts(quarter: Column, year: Column, text: Column) -> Column:
    """The label is a period other than the row's own; unreadable labels, and rows of no quarter or year, contradict nothing."""
    p, own = parse_label(text), F.trim(year.cast("string")).try_cast("int")
    return F.coalesce((p["fq"] != quarter_index(F.trim(quarter))) | (p["fy"] != own), F.lit(False)) & F.upper(F.trim(quarter)).startswith("Q")


def suspect(quarter: Column, year: Column, text: Column) -> Column:
    """A bad label, one of another window, or, where the row has a year, one of another period."""
    return bad_label(text) | window_mismatch(quarter, text) | F.coalesce(contradicts(quarter, year, text), F.lit(False))


def question_periods(question: Column, year: Column | None = None, quarter: Column | None = None) -> Column:
    """array of struct(q, fy) that a question is about, once each, in this order.

    Its explicit periods; the unnamed partner of a single one compared on the quarter or year; every quarter of its fiscal
    years, or the years as a whole (q = 'FY'), where its words ask for these; the period of its metadata.
    """
    text = F.coalesce(question, F.lit(""))
    pair = lambda q, fy: F.struct(q.alias("q"), fy.cast("string").alias("fy"))
    found = lambda i: F.regexp_extract_all(text, F.lit(ASKED_PERIOD), i)
    named = F.zip_with(found(1), found(2), lambda q, fy: pair(F.concat(F.lit("Q"), q), long_year(fy)))
    none = F.filter(F.array(pair(F.lit(""), F.lit("0"))), lambda x: F.lit(False))

    def partner(by: int) -> Column:
        fy, q = shift(F.get(named, F.lit(0))["fy"].cast("int"), F.substring(F.get(named, F.lit(0))["q"], 2, 1).cast("int"), by)
        return F.array(pair(F.concat(F.lit("Q"), q.cast("string")), fy))

    single = (F.size(named) == 1) & ~text.rlike(WIDE_TREND)
    implied = F.when(single & text.rlike(QOQ), partner(-1)).when(single & text.rlike(YOY), partner(-4)).otherwise(none)
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ASKED_YEAR), 1), long_year)))
    quarters = F.flatten(F.transform(years, lambda y: F.array(*[pair(F.lit(f"Q{i}"), y) for i in (1, 2, 3, 4)])))
    spread = F.when(text.rlike(EVERY_QUARTER), quarters).when(text.rlike(WHOLE_YEAR), F.transform(years, lambda y: pair(F.lit("FY"), y))).otherwise(none)
    parts = [named, implied, spread]
    if year is not None and quarter is not None:
        own = F.upper(quarter)
        parts.append(F.when(own.isin("Q1", "Q2", "Q3", "Q4") & (F.coalesce(year.cast("string"), F.lit("")) != ""), F.array(pair(own, year))).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def in_years(year: Column, wanted: Column) -> Column:
    """The wanted year, or one of an inclusive range 'yyyy-yyyy'; an empty wish is no filter."""
    own, want = F.trim(F.coalesce(year.cast("string"), F.lit(""))), F.trim(F.coalesce(wanted.cast("string"), F.lit("")))
    bounds = [F.regexp_extract(want, r"^(\d{4})\s*-\s*(\d{4})$", i).try_cast("int") for i in (1, 2)]
    number = F.when(own.rlike(r"^\d+$"), own).try_cast("int")
    return (want == "") | F.when(bounds[0].isNotNull(), F.coalesce(number.between(*bounds), F.lit(False))).otherwise(own == want)


def in_quarter(quarter: Column, wanted: Column) -> Column:
    """The wanted quarter; words for a whole year are no filter."""
    own, want = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (quarter, wanted))
    return want.isin(*NO_QUARTER) | (own == want)


def in_source(source: Column, wanted: Column) -> Column:
    """The wanted source type, if it is pdf or audio; any other wish is no filter."""
    want = F.coalesce(wanted, F.lit(""))
    return ~want.isin("pdf", "audio") | F.coalesce(source == want, F.lit(False))
