"""Numbers in text, and scores that compare sets of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, as no data, and as a period label that is blanked before.
NUMBER = r"-?\d[\d,]*\.?\d*%?"
NO_DATA = ("", "-", "--", "—", "–", "na", "n/a", "nil", "nan")
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
PERIOD_LABEL = (
    r"(?i)\bQ[1-4]\s*-\s*\d{2,4}\b|\b" + _MONTH + r"\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{2,4}\b|\bQ[1-4]\s*(?:FY\s*)?['’]?\d{2,4}\b|\bFY\s*['’]?\d{2,4}\b|\b" + _MONTH + r"\s+['’]?\d{2,4}\b|\bQ[1-4]\b"
)
UNITS = (
    (r"(?i)(₹|rs\.?)\s*(in\s*)?crore", "Crore INR"), (r"(?i)(₹|rs\.?)\s*(in\s*)?lakh", "Lakh INR"), (r"(?i)(₹|rs\.?|inr)\s*(in\s*)?million", "Million INR"),
    (r"(?i)(₹|rs\.?|inr)\s*(in\s*)?billion", "Billion INR"), (r"(?i)(usd|\$)\s*(in\s*)?million", "Million USD"), (r"(?i)(usd|\$)\s*(in\s*)?billion", "Billion USD"),
    (r"(?i)\bcrore\b", "Crore INR"), (r"(?i)\blakh[s]?\b", "Lakh INR"),
)


def parse_numeric(raw: Column) -> Column:
    """A double without commas, per cent and blanks, brackets meaning minus; null where it is no number."""
    flat = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[,%\s]", "")
    negative = flat.rlike(r"^\(.*\)$")
    body = F.regexp_replace(flat, r"^\((.*)\)$", "$1")
    value = F.when(body.rlike(r"^-?\d+(\.\d+)?$"), body).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def parse_cell(raw: Column) -> Column:
    """struct(value, unit) of a table cell; value is a string, nulls where the cell is not confidently a number."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    bracket = text.rlike(r"^\(.*\)$")
    body = F.trim(F.regexp_replace(text, r"^\((.*)\)$", "$1"))
    percent = body.endswith("%")
    body = F.regexp_replace(F.regexp_replace(body, r"%$", ""), r"(?i)^\s*(₹|rs\.?|inr|usd|\$)\s*", "")
    body = F.regexp_replace(body, r"(\d)'(\d)", "$1$2")
    body = F.replace(F.replace(body, F.lit(" ")), F.lit(","))
    negative = bracket | body.startswith("-") | body.endswith("-")
    body = F.regexp_replace(body, r"^-|-$", "")
    ok = ~F.lower(text).isin(*NO_DATA) & body.rlike(r"^\d+(\.\d+)?$")
    return F.struct(F.when(ok, F.concat(F.when(negative, "-").otherwise(""), body)).alias("value"), F.when(ok & percent, "%").alias("unit"))


def ocr_token(raw: Column) -> Column:
    """A recognised word as a plain number, or null: brackets or braces mean minus, a last comma before two digits a point."""
    text = F.replace(F.replace(F.trim(F.coalesce(raw, F.lit(""))), F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")"))
    bracket = text.rlike(r"^\(.*\)$")
    body = F.regexp_replace(F.when(bracket, F.regexp_replace(text, r"^\((.*)\)$", "$1")).otherwise(text), "%+$", "")
    body = F.when(body.contains("."), body).otherwise(F.regexp_replace(body, r",(\d{2})$", ".$1"))
    body = F.replace(body, F.lit(","))
    return F.when(body.rlike(r"^-?\d+\.?\d*$"), F.concat(F.when(bracket, "-").otherwise(""), body))


def unit_of(text: Column) -> Column:
    out = None
    for pattern, unit in UNITS:
        out = F.when(text.rlike(pattern), unit) if out is None else out.when(text.rlike(pattern), unit)
    return out


def number_set(text: Column) -> Column:
    """Distinct numbers of a text, without commas."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0)
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","))))


def answer_numbers(text: Column, marker: str = "FINAL ANSWER:") -> Column:
    """Numbers after the first marker, else of the whole text; period labels are no numbers."""
    at = F.instr(text, marker)
    body = F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text)
    return number_set(F.regexp_replace(F.coalesce(body, F.lit("")), PERIOD_LABEL, " "))


def canonical(numbers: Column) -> Column:
    """Numbers as value and per-cent sign, so that spellings of one value agree."""
    return F.array_distinct(F.transform(numbers, _canon))


def _canon(x: Column) -> Column:
    return F.concat(F.round(F.regexp_replace(x, "[%]", "").try_cast("double"), 9).cast("string"), F.when(x.endswith("%"), "%").otherwise(""))


def matched(pred: Column, truth: Column) -> Column:
    return F.size(F.array_intersect(canonical(pred), canonical(truth)))


def unmatched(a: Column, b: Column) -> Column:
    """Numbers of ``a`` whose value no number of ``b`` has, sorted: missing ones of the truth, or extra ones of the answer."""
    own = canonical(b)
    return F.array_sort(F.filter(a, lambda x: ~F.array_contains(own, _canon(x))))


def share_matched(a: Column, b: Column) -> Column:
    """Share of ``a``'s numbers that ``b`` has; null without any. Of the truth: partial match; of the answer: consistency."""
    return F.when(F.size(a) > 0, matched(a, b) / F.size(a))


def invented(pred: Column, evidence: Column, truth: Column) -> Column:
    """How many numbers of an answer stand neither in the evidence nor in the truth, as written."""
    return F.size(F.array_except(pred, F.array_union(evidence, truth)))


def quarter_years(text: Column) -> Column:
    """Distinct 'q-yy' pairs of a text."""
    pattern = F.lit(r"(?i)Q([1-4])[\s\-]*(?:FY)?[\s\-]*(\d{2,4})")
    flat = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.zip_with(F.regexp_extract_all(flat, pattern, 1), F.regexp_extract_all(flat, pattern, 2), lambda q, y: F.concat_ws("-", q, F.right(y, F.lit(2)))))


def is_multivalue(truth: Column) -> Column:
    return F.size(truth) >= 3


def multivalue_complete(answer: Column, truth: Column, expected: Column | None = None) -> Column:
    """Whether every number of a truth with three or more was given; where an answer that is a period is expected, whether it
    names that period; else null."""
    pred, gold = answer_numbers(answer), answer_numbers(truth)
    every = F.when(is_multivalue(gold), (matched(pred, gold) == F.size(gold)).cast("int"))
    if expected is None:
        return every
    want = quarter_years(expected)
    return F.when(F.size(want) > 0, F.arrays_overlap(want, quarter_years(answer)).cast("int")).otherwise(every)


def precision_recall(pred: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall, F1 and exact match; null where the truth has no number."""
    some = F.size(truth) > 0
    m = matched(pred, truth)
    p = F.when(F.size(pred) > 0, m / F.size(pred)).otherwise(0.0)
    r = m / F.size(truth)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    exact = (m == F.size(truth)) & (F.size(pred) == F.size(truth))
    return {"precision": F.when(some, p), "recall": F.when(some, r), "f1": F.when(some, f1), "exact": F.when(some, exact)}


def within_tolerance(pred: Column, truth: Column, share: float = 0.01) -> Column:
    """Whether every number of the truth lies within ``share`` of some number given; null without any."""
    value = lambda x: F.regexp_replace(x, "%", "").try_cast("double")
    near = lambda a, b: F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))
    return F.when(F.size(truth) > 0, F.forall(truth, lambda g: F.exists(pred, lambda p: F.coalesce(near(value(g), value(p)), F.lit(False)))))


def sufficiency(evidence: Column, truth: Column) -> Column:
    """Share of the truth's numbers that stand in the evidence."""
    flat = F.replace(F.coalesce(evidence, F.lit("")), F.lit(","))
    return F.when(F.size(truth) > 0, F.size(F.filter(truth, lambda g: F.contains(flat, F.regexp_replace(g, "%", "")))) / F.size(truth))


def min_max(x: Column, window) -> Column:
    """Scaled to 0..1 over a window; a flat one gives 0.5."""
    lo, hi = F.min(x).over(window), F.max(x).over(window)
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.5)


def two_places(x: Column) -> Column:
    """A double with two decimals as C's '%.2f' writes it: the exact binary value rounds, half to even, and the sign of a negative
    that rounds to zero stays. A cast to decimal rounds the shortest decimal form instead, half up: 2.675 is below its tie.

    The product with 1000 is taken with its error (Dekker), so a tie is told from its neighbours. Null beyond 9e12 and for no number.
    """
    a = F.abs(x)
    big = a * 134217729.0
    high = big - (big - a)
    p = a * 1000.0
    error = (high * 1000.0 - p) + (a - high) * 1000.0
    m = F.rint(p)
    rest = (p - m) + error
    whole = m.cast("long")
    tenth, last = F.floor(whole / 10).cast("long"), F.pmod(whole, F.lit(10))
    up = (last > 5) | ((last == 5) & ((rest > 0) | ((rest == 0) & (F.pmod(tenth, F.lit(2)) == 1))))
    n = tenth + up.cast("long")
    minus = F.when((x < 0) | ((x == 0) & x.cast("string").startswith("-")), "-").otherwise("")
    return F.when(a < 9e12, F.concat(minus, F.floor(n / 100).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(100)).cast("string"), 2, "0")))
