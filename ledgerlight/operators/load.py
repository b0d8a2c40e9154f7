"""From extractions to vertex and edge tables.

An extraction is (chunk_id, quarter_id, chunk_type, piece, entities, relationships, metrics, guidance, risks, sentiment); a chunk
that was cut into pieces has several. Upserts are `graph.upsert` on the ids made here.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import relation_name

EXTRACTION = (
    "entities array<struct<name: string, type: string>>, relationships array<struct<source: string, source_type: string, relation: string, target: string, target_type: string>>, "
    "metrics array<struct<name: string, value: string, unit: string, period: string>>, guidance array<struct<statement: string, topic: string>>, "
    "risks array<struct<statement: string, type: string>>, sentiment string"
)
LISTS = ("entities", "relationships", "metrics", "guidance", "risks")


def merge_pieces(extractions: DataFrame) -> DataFrame:
    """One row per chunk: its pieces' lists one after the other, and the first sentiment that is not empty."""
    packed = F.array_sort(F.collect_list(F.struct("piece", *LISTS)))
    mood = F.min_by("sentiment", F.when(F.coalesce("sentiment", F.lit("")) != "", F.col("piece")))
    rows = extractions.groupBy("chunk_id", "quarter_id", "chunk_type").agg(packed.alias("p"), mood.alias("sentiment"))
    joined = [F.flatten(F.array_compact(F.transform("p", _field(c)))).alias(c) for c in LISTS]
    return rows.select("chunk_id", "quarter_id", "chunk_type", *joined, "sentiment")


def _field(name: str):
    return lambda x: x[name]


def _given(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def entity_id(kind: Column, name: Column) -> Column:
    """'type:name', or the name alone without a type."""
    return F.when(_given(kind), F.concat_ws(":", kind, name)).otherwise(name)


def entities(chunks: DataFrame) -> DataFrame:
    """(id, name, type) of entities with both, once each."""
    rows = chunks.select(F.explode("entities").alias("e")).where(_given(F.col("e.name")) & _given(F.col("e.type")))
    return rows.select(entity_id(F.col("e.type"), F.col("e.name")).alias("id"), "e.name", "e.type").distinct()


def mentions(chunks: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) from chunks to their entities."""
    rows = chunks.select("chunk_id", F.explode("entities").alias("e")).where(_given(F.col("e.name")) & _given(F.col("e.type")))
    return rows.select(F.col("chunk_id").alias("src"), F.lit("MENTIONS").alias("rel"), entity_id(F.col("e.type"), F.col("e.name")).alias("dst")).distinct()


def relations(chunks: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) between entities, under the relation's normalised name; those without a sound name or an end go."""
    r = chunks.select(F.explode("relationships").alias("r"))
    rows = r.select(entity_id(F.col("r.source_type"), F.col("r.source")).alias("src"), relation_name(F.col("r.relation")).alias("rel"), entity_id(F.col("r.target_type"), F.col("r.target")).alias("dst"))
    return rows.where(F.col("rel").isNotNull() & _given(F.col("src")) & _given(F.col("dst"))).distinct()


def metric_nodes(chunks: DataFrame) -> DataFrame:
    """(id, quarter_id, name, value, unit, period, source_chunk_id); the id holds the period, and a later chunk wins."""
    m = chunks.select("chunk_id", "quarter_id", F.posexplode("metrics").alias("at", "m")).where(_given(F.col("m.name")))
    m = m.withColumn("id", F.concat_ws("|", "quarter_id", "m.name", F.coalesce("m.period", F.lit(""))))
    last = m.groupBy("id", "quarter_id").agg(F.max_by(F.struct("m.name", "m.value", "m.unit", "m.period", F.col("chunk_id").alias("source_chunk_id")), F.struct("chunk_id", "at")).alias("x"))
    return last.select("id", "quarter_id", "x.*")


def metric_edges(chunks: DataFrame) -> DataFrame:
    """Edges to metrics from their quarter (HAS_METRIC) and their chunk (CONTAINS_METRIC)."""
    m = chunks.select("chunk_id", "quarter_id", F.explode("metrics").alias("m")).where(_given(F.col("m.name")))
    m = m.withColumn("dst", F.concat_ws("|", "quarter_id", "m.name", F.coalesce("m.period", F.lit(""))))
    side = lambda c, rel: m.select(F.col(c).alias("src"), F.lit(rel).alias("rel"), "dst")
    return side("quarter_id", "HAS_METRIC").union(side("chunk_id", "CONTAINS_METRIC")).distinct()


def statements(chunks: DataFrame, kind: str) -> DataFrame:
    """(id, quarter_id, chunk_id, statement, label) of guidance or risks; raw tables have none. Ids are hashes of the statement."""
    label = {"guidance": "topic", "risks": "type"}[kind]
    rows = chunks.where(F.coalesce("chunk_type", F.lit("")) != "table").select("chunk_id", "quarter_id", F.explode(kind).alias("s")).where(_given(F.col("s.statement")))
    return rows.select(F.sha2(F.col("s.statement"), 256).alias("id"), "quarter_id", "chunk_id", "s.statement", F.col("s")[label].alias("label")).distinct()


def latest_sentiment(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """(quarter_id, sentiment): the last one written to each quarter."""
    rows = chunks.where(_given(F.col("sentiment")))
    return rows.groupBy("quarter_id").agg(F.max_by("sentiment", order).alias("sentiment"))


def quarter_nodes(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct quarters (id, company, year, quarter), and the companies' HAS_QUARTER edges."""
    rows = chunks.select("company", "year", "quarter").distinct()
    nodes = rows.select(F.concat_ws("_", "company", "year", "quarter").alias("id"), "company", "year", "quarter")
    return nodes, nodes.select(F.col("company").alias("src"), F.lit("HAS_QUARTER").alias("rel"), F.col("id").alias("dst"))


def cache_key(chunk_type: Column, text: Column) -> Column:
    """Equal for texts of one type that differ in white space only."""
    return F.sha2(F.concat(chunk_type, F.lit(":"), F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


# ------------------------------------------------------------------ replies of a model


def strip_fence(text: Column) -> Column:
    """A reply without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*|\s*```$", ""))


def repaired(text: str) -> str | None:
    """Broken-off JSON cut behind its last whole array element, with all brackets closed; null where there is none."""
    open_, best, quoted, at = [], None, False, 0
    while at < len(text):
        sign = text[at]
        if quoted:
            at += sign == "\\"
            quoted = sign != '"'
        elif sign == '"':
            quoted = True
        elif sign in "[{":
            open_.append("]" if sign == "[" else "}")
        elif sign in "]}":
            del open_[-1:]
        elif sign == "," and open_[-1:] == ["]"]:
            best = text[:at].rstrip() + "".join(reversed(open_))
        at += 1
    return best


def parse_replies(rows: DataFrame, key: str = "id", text: str = "text", schema: str = EXTRACTION) -> DataFrame:
    """(key, status, reply...): replies as they are, repaired where they broke off, else failed with nulls."""

    def run(batches):
        import pyarrow as pa

        def read(t: str) -> tuple[str, str | None]:
            for status, body in (("ok", t), ("repaired", repaired(t))):
                try:
                    if isinstance(json.loads(body), dict):
                        return status, body
                except (TypeError, ValueError):
                    pass
            return "failed", None

        for batch in batches:
            got = [read(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got]), pa.array([b for _, b in got], pa.string())], [key, "status", "body"])

    kind = dict(rows.dtypes)[key]
    out = rows.select(key, strip_fence(F.col(text)).alias("t")).mapInArrow(run, f"{key} {kind}, status string, body string")
    return out.select(key, "status", F.from_json("body", schema).alias("r")).select(key, "status", "r.*")
