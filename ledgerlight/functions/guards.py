"""Guards of extracted figures, and values read again from the text they came from, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash

# Names of rates and revenues, sub-items lettered (a) (b) (c), where a row of figures ends, a figure.
RATE_NAME = r"(?i)\b(growth|margin|change|yoy|qoq|rate|ratio|percentage|ROI|ROE|CAGR)\b"
REVENUE_NAME = r"(?i)\b(revenue|sales|turnover)\b"
LETTERED = r"(?is)\(a\)\s*\(b\)\s*\(c\)|\(a\).{0,150}?\(b\).{0,150}?\(c\)"
DOLLARS = r"(?i)\busd\b|\$"
FIGURE = r"(?<![A-Za-z])(?:\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![A-Za-z])"
ROW_END = r"(?=\bother income\b|\bexpenses?\b|$)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def quoted(text: Column) -> Column:
    """A text as a literal inside a pattern built per row."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\\\$1")


def implausible_unit(unit: Column, source: Column) -> Column:
    """Dollars that the source text never mentions."""
    return _text(unit).rlike(DOLLARS) & ~_text(source).rlike(DOLLARS)


def stray_percentage(name: Column, value: Column) -> Column:
    """A bare percentage under a name that is no rate."""
    return _text(value).rlike(r"^\s*-?\d+(\.\d+)?\s*%\s*$") & ~_text(name).rlike(RATE_NAME)


def absent_from_source(value: Column, source: Column) -> Column:
    """The figure stands nowhere in the source, separators aside, nor without trailing zeros; an empty side is no evidence."""
    flat, v = (F.regexp_replace(_text(c), r"[\s,]", "") for c in (source, value))
    short = F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.+$", "")
    there = flat.contains(v) | (v.endswith(".0") & flat.contains(F.regexp_replace(v, r"\.0$", ""))) | (v.contains(".") & flat.contains(short))
    return (v != "") & (flat != "") & ~there


def small_revenue(name: Column, value: Column) -> Column:
    """A revenue of absolute value under 10; what is no plain number is not judged."""
    number = F.trim(F.replace(_text(value), F.lit(","))).try_cast("double")
    return _text(name).rlike(REVENUE_NAME) & F.coalesce(F.abs(number) < 10, F.lit(False))


def ambiguous_breakdown(name: Column, source: Column) -> Column:
    """A revenue whose source lists lettered sub-items and no clean total row."""
    text = squash(_text(source))
    total = F.regexp_like(text, F.concat(F.lit(r"(?i)\btotal\s+"), quoted(_text(name)), F.lit(r"\b")))
    return _text(name).rlike(REVENUE_NAME) & text.rlike(LETTERED) & ~total


def current_value(source: Column, name: Column) -> Column:
    """The first figure on the metric's total row, else on its own row, else, for earnings per share, on the Basic or Diluted
    row of that section; rows with lettered sub-items are passed over. Null where no row has a figure."""
    text, label = squash(_text(source)), quoted(_text(name))
    kind = F.lower(F.regexp_extract(_text(name), r"(?i)\b(basic|diluted)\b", 1))

    def figure(pattern: Column) -> Column:
        span = F.call_function("regexp_extract", text, pattern, F.lit(1))
        hit = F.replace(F.regexp_extract(span, FIGURE, 0), F.lit(","))
        return F.when(~span.rlike(LETTERED), F.nullif(hit, F.lit("")))

    own = [F.concat(F.lit(head), label, F.lit(r"\b(.*?)" + ROW_END)) for head in (r"(?i)\btotal\s+", r"(?i)\b")]
    eps = F.concat(F.lit(r"(?i)\bearning\s*per\s*share\b.*?\b"), kind, F.lit(r"\b\s*(.*?)(?=\b(?:basic|diluted)\b|\(eps for the quarter|$)"))
    return F.coalesce(*map(figure, own), F.when(kind != "", figure(eps)))
