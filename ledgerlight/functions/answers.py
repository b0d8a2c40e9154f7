"""Rendered facts and answers: what a fact string says, and deterministic repairs of an answer, as column expressions.

A metric fact reads ``name = value unit (Qn-yyyy) [tag=...; tag=...]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import bad_label

# The answer's last line, questions that ask for a change, changes appended unasked, and the order of metrics.
MARKER = "FINAL ANSWER:"
ASKS_DELTA = r"(?i)\b(by how much|how much (?:did|has|is)|what (?:was|is) the change|what growth rate|growth rate|percentage change|% change|the difference|change in)\b"
TRAILING_DELTA = (
    r"(?i)\s*[;,]?\s*(?:change|delta|difference)\s*[:=].*$",
    r"\s*\([+\-]\s*[\d.,]+(?:\s*[a-zA-Z]+)?\s*(?:\([+\-]\s*[\d.,]+\s*%\))?\s*\)\s*$",
    r"\s*\([+\-]\s*[\d.,]+\s*%\)\s*$",
)
METRIC_ORDER = ("revenue", "ebitda", "net profit", "profit after tax", "pat", "profit before tax", "pbt", "eps", "margin", "growth", "expense", "cost", "tax")
SECTIONS = (("metric", "Metrics"), ("entity", "Entities"), ("guidance", "Guidance"), ("risk", "Risks"), ("sentiment", "Sentiment"))
QUESTION_STOPWORDS = (
    "what", "was", "is", "the", "for", "in", "of", "a", "an", "to", "did", "how", "much", "were", "are", "this", "that", "company", "companys", "limited",
    "during", "quarter", "year", "fy",
)
RECOVERED = "derived_from=raw_chunk"
LOW_CONFIDENCE = "confidence=low"
_FIGURE = r"\d[\d,]*\.?\d*"


# ------------------------------------------------------------------ facts


def category(fact: Column) -> Column:
    """guidance, risk, sentiment, entity or metric, by how the fact begins or that it has an edge."""
    return F.when(fact.startswith("Guidance"), "guidance").when(fact.startswith("Risk"), "risk").when(fact.startswith("Management sentiment:"), "sentiment").when(fact.contains(" -["), "entity").otherwise("metric")


def metric_name(fact: Column) -> Column:
    return F.substring_index(fact, " = ", 1)


def base_name(fact: Column) -> Column:
    """The metric's name without its statement type and brackets."""
    plain = F.regexp_replace(metric_name(fact), r"(?i)\b(standalone|consolidated)\b", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"[()\s]+", " ")))


def name_tokens(fact: Column) -> Column:
    """Distinct words of over four letters in the name."""
    plain = F.regexp_replace(metric_name(fact), r"(?i)\b(standalone|consolidated)\b", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(plain), F.lit("([a-z]+)"), 1), lambda t: F.length(t) > 4))


def company_tag(fact: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(fact, r"company=([^;\]]+)", 1)))


def period_tag(fact: Column) -> Column:
    return F.regexp_extract(fact, r"\((Q[1-4]|FY)-(\d{4})\)", 0)


def statement_kind(fact: Column) -> Column:
    """consolidated before standalone; null for a fact that names neither."""
    return F.when(fact.rlike(r"(?i)\bconsolidated\b"), "consolidated").when(fact.rlike(r"(?i)\bstandalone\b"), "standalone")


def claims_period(fact: Column) -> Column:
    """A tag backs the fact: a sound period, or a statement type."""
    period = F.trim(F.regexp_extract(fact, r"period=([^;\]]+)", 1))
    return ((period != "") & ~bad_label(period)) | fact.contains("statement=")


def question_words(question: Column) -> Column:
    """Words of a question that may name a metric."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*QUESTION_STOPWORDS)))


def display_order(fact: Column) -> list[Column]:
    """Sort keys of facts in a prompt: section, then metrics by importance, then the text."""
    kind, name = category(fact), F.lower(metric_name(fact))
    place = F.coalesce(*[F.when(kind == k, i) for i, (k, _) in enumerate(SECTIONS)])
    rank = F.coalesce(*[F.when(name.contains(w), i) for i, w in enumerate(METRIC_ORDER)], F.lit(len(METRIC_ORDER)))
    return [place, F.when(kind == "metric", rank).otherwise(0), fact]


def direct_answer(fact: Column) -> Column:
    """'name: value unit (Qn-yyyy)' of a metric fact, without its tags."""
    core = F.substring_index(fact, " [", 1)
    return F.concat(F.trim(F.substring_index(core, " = ", 1)), F.lit(": "), F.trim(F.regexp_replace(core, r"^.*? = ", "")))


# ------------------------------------------------------------------ answers


def _tail(answer: Column, edit) -> Column:
    """The answer with ``edit`` applied behind its last marker; without a marker it stays."""
    tail = F.substring_index(answer, MARKER, -1)
    head = F.substring(answer, F.lit(1), F.length(answer) - F.length(tail))
    return F.when(answer.contains(MARKER), F.concat(head, edit(tail))).otherwise(answer)


def strip_delta(answer: Column, question: Column | None = None) -> Column:
    """Drops a change appended to the final line, unless the question asks for one."""

    def edit(tail: Column) -> Column:
        for pattern in TRAILING_DELTA:
            tail = F.regexp_replace(tail, pattern, "")
        return tail

    out = _tail(answer, edit)
    return out if question is None else F.when(F.coalesce(question, F.lit("")).rlike(ASKS_DELTA), answer).otherwise(out)


def fix_decimal_shift(answer: Column, evidence: Column) -> Column:
    """Figures of the final line whose digits, four or more, stand in the evidence with another point are written as there.

    The tail is cut into figures and what lies between them; the first figure of the evidence with equal digits counts.
    """
    digits = lambda x: F.regexp_replace(x, "[,.]", "")
    known = F.filter(F.regexp_extract_all(F.coalesce(evidence, F.lit("")), F.lit(_FIGURE), 0), lambda x: F.length(digits(x)) >= 4)
    keys = F.transform(known, digits)

    def right(x: Column) -> Column:
        at = F.array_position(keys, digits(x)).cast("int")
        return F.when((F.length(digits(x)) >= 4) & (at > 0), F.get(known, at - 1)).otherwise(x)

    def edit(tail: Column) -> Column:
        figures = F.concat(F.transform(F.regexp_extract_all(tail, F.lit(_FIGURE), 0), right), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(tail, _FIGURE, -1), figures, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return _tail(answer, edit)
