"""Chains of facts over fiscal periods: windows and self joins, never loops over companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import change_type


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``; ties must be broken by it. Combined on the map side, so hot keys are cheap."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *rest)).alias("v")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def quarter_chain(quarters: DataFrame) -> DataFrame:
    """(company, fy, fq) -> each quarter with the company's next one; gaps are bridged."""
    w = Window.partitionBy("company").orderBy("fy", "fq")
    own = quarters.select("company", "fy", "fq").distinct()
    return own.withColumn("next_fy", F.lead("fy").over(w)).withColumn("next_fq", F.lead("fq").over(w))


def same_quarter_last_year(quarters: DataFrame) -> DataFrame:
    own = quarters.select("company", "fy", "fq").distinct()
    before = own.select("company", (F.col("fy") + 1).alias("fy"), "fq", F.col("fy").alias("prev_fy"))
    return own.join(before, ["company", "fy", "fq"])


def evolution(metrics: DataFrame, value: str = "value") -> DataFrame:
    """(company, name, fy, fq, value) -> each value with the one before: delta, percent and kind of change."""
    w = Window.partitionBy("company", "name").orderBy("fy", "fq")
    rows = metrics
    for c in ("fy", "fq", value):
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(w))
    rows = rows.where("prev_fy is not null").withColumn("delta", F.col(value) - F.col(f"prev_{value}"))
    rows = rows.withColumn("percent_change", F.when(F.col(f"prev_{value}") != 0, F.col("delta") / F.abs(f"prev_{value}") * 100))
    return rows.withColumn("change_type", change_type(F.col("prev_fy"), F.col("prev_fq"), F.col("fy"), F.col("fq")))


def year_on_year(metrics: DataFrame, value: str = "value") -> DataFrame:
    """Each value with that of the same quarter a year before; duplicates of a key must be resolved first."""
    before = metrics.select("company", "name", (F.col("fy") + 1).alias("fy"), "fq", F.col(value).alias(f"prev_{value}"))
    rows = metrics.join(before, ["company", "name", "fy", "fq"]).withColumn("delta", F.col(value) - F.col(f"prev_{value}"))
    return rows.withColumn("percent_change", F.when(F.col(f"prev_{value}") != 0, F.col("delta") / F.abs(f"prev_{value}") * 100))


def mention_chain(mentions: DataFrame, topic: str, at: str) -> DataFrame:
    """Mentions of a topic by a company in order: each with the next one (UPDATED_TO, PERSISTED_TO)."""
    w = Window.partitionBy("company", topic).orderBy(at, "id")
    return mentions.withColumn("next_id", F.lead("id").over(w)).where("next_id is not null")


def temporal_triple(metrics: DataFrame) -> DataFrame:
    """Each value with the previous, the next and last year's value, nulls where there is none."""
    w = Window.partitionBy("company", "name").orderBy("fy", "fq")
    rows = metrics.withColumn("prev_value", F.lag("value").over(w)).withColumn("next_value", F.lead("value").over(w))
    before = metrics.select("company", "name", (F.col("fy") + 1).alias("fy"), "fq", F.col("value").alias("yoy_value"))
    return rows.join(before, ["company", "name", "fy", "fq"], "left")


def continuity(mentions: DataFrame, edges: DataFrame, compat: bool = False) -> DataFrame:
    """Mentions with their predecessor along UPDATED_TO or PERSISTED_TO edges; ``compat`` keeps those without one."""
    before = edges.select(F.col("next_id").alias("id"), F.col("id").alias("prev_id"))
    return mentions.join(before, "id", "left" if compat else "inner")
