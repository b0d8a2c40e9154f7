"""Question routing and metric names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import hits, is_numeric_question

# Keyword lists of the router; they are tested as substrings.
PDF_WORDS = ("revenue", "profit", "margin", "balance sheet", "income statement", "npa", "aum", "ebitda", "eps", "what was", "how much", "total", "expenses", "assets", "liabilities")
AUDIO_WORDS = (
    "said", "guidance", "outlook", "ceo", "cfo", "management", "strategy", "commentary", "plan to", "expect", "why did", "explain", "highlight", "highlighted",
    "initiative", "initiatives", "launch", "launches", "launched", "discuss", "discussed", "mention", "mentioned", "concern", "concerns", "challenge",
    "challenges", "call", "report alongside", "reported alongside", "noted", "stated", "attributed",
)
COMPARISON_WORDS = (
    "compare", "versus", "vs", "beat", "year-over-year", "year-on-year", "year on year", "yoy", "sequential", "quarter-on-quarter", "quarter on quarter",
    "month-on-month", "month on month", "period-on-period", "period on period", "trend", "grown", "growth over", "change over", "compared with", "compared to",
    "higher than", "lower than", "which year", "which quarter", "highest", "lowest", "between", "from 2024 to", "from 2025 to", "from 2024 through",
    "from 2025 through", "over the last", "over the past", "quarter-over-quarter", "qoq",
)
TEMPORAL_WORDS = (
    "year-over-year", "year-on-year", "year on year", "yoy", "sequential", "trend", "quarter-over-quarter", "quarter-on-quarter", "quarter on quarter",
    "month-on-month", "month on month", "period-on-period", "period on period", "qoq", "over the last", "over the past", "grown", "growth over", "which year",
    "which quarter", "highest", "lowest", "between",
)
METRIC_NAMES = (
    ("revenue from operations", "Revenue from operations"), ("revenue", "Revenue from operations"), ("basic earnings per share", "Basic EPS"), ("basic eps", "Basic EPS"),
    ("diluted earnings per share", "Diluted EPS"), ("diluted eps", "Diluted EPS"), ("earnings per share", "Basic EPS"), ("profit after tax", "Profit after tax"),
    ("net profit for the period", "Net profit for the period"), ("net profit", "Net profit for the period"), ("pat", "PAT"), ("ebitda", "EBITDA"), ("interest income", "Interest income"),
)


def route(q: Column) -> dict[str, Column]:
    """pdf_score, audio_score, is_comparison, is_temporal, source_filter and is_numeric of a question."""
    low = F.lower(q)
    pdf, audio = hits(low, PDF_WORDS), hits(low, AUDIO_WORDS)
    compare, temporal = hits(low, COMPARISON_WORDS) > 0, hits(low, TEMPORAL_WORDS) > 0
    source = F.when((pdf > 0) & (audio > 0), "both").when(pdf > audio, "pdf").when(audio > pdf, "audio").otherwise("both")
    return {"pdf_score": pdf, "audio_score": audio, "is_comparison": compare, "is_temporal": temporal, "source_filter": source, "is_numeric": is_numeric_question(q)}


def metric_names(q: Column) -> Column:
    """Names of the metrics a question asks for, in declared order, once each."""
    low = F.lower(F.coalesce(q, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(needle), F.lit(name)) for needle, name in METRIC_NAMES])))


def fact_budget(q: Column) -> Column:
    """24 facts for trends or three periods, 16 for temporal questions of two, else 10."""
    low = F.lower(q)
    periods = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\bq[1-4]\b"), 0)))
    return F.when(low.contains("trend") | (periods >= 3), 24).when((hits(low, TEMPORAL_WORDS) > 0) & (periods >= 2), 16).otherwise(10)
