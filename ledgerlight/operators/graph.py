"""Vertex and edge tables: upserts, cross links, and structural vectors by random projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .projection import fast_rp  # noqa: F401
from .retrieval import dot
from .temporal import last_per_key


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str = "load_seq") -> DataFrame:
    """Last writer wins per key."""
    return last_per_key(old.unionByName(new), key, [F.col(seq)])


def replace_relation(edges: DataFrame, rel: str, new: DataFrame) -> DataFrame:
    """All edges (src, rel, dst) with those of one relation rebuilt from ``new`` (src, dst)."""
    return edges.where(~F.col("rel").eqNullSafe(F.lit(rel))).unionByName(new.select("src", F.lit(rel).alias("rel"), "dst").distinct())


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Empty where the key is unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def relation_name(raw):
    """Upper case with underscores; null where other signs remain."""
    name = F.regexp_replace(F.upper(F.trim(raw)), r"\s+", "_")
    return F.when(name.rlike("^[A-Z0-9_]+$"), name)


def crosslink(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct (left_id, right_id) pairs that share the columns ``on``."""
    return left.distinct().join(right.distinct(), on).select("left_id", "right_id").distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Distinct nodes reached from ``seeds`` (node) in exactly ``hops`` directed steps."""
    at = seeds.select("node").distinct()
    for _ in range(hops):
        at = edges.join(at, edges["src"] == at["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
    return at


def structural_similarity(vectors: DataFrame, a: str, b: str):
    return dot(F.col(a), F.col(b))
