"""Chains and summaries over a stream of mentions, by Structured Streaming.

An extension: batch operators cover the scope; these keep the latest state per key up to date as mentions arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mentions(stream: DataFrame, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """Mentions per company, topic and window of event time ``at``; later ones than the watermark are left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "company", "topic").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


def latest_mention(stream: DataFrame) -> DataFrame:
    """The last mention of each company and topic, in update mode."""
    return stream.groupBy("company", "topic").agg(F.max_by("id", F.struct("at", "id")).alias("id"), F.max("at").alias("at"))
