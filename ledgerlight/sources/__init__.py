"""Sources and sinks: chunk JSON, ground truth, results, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = (
    "chunk_id string, chunk_type string, source_type string, document_name string, source_file_hash string, processed_at string, page int, page_type string, heading string, "
    "section string, title string, headers array<string>, rows array<array<string>>, text string, embedding_text string, speaker string, start double, end double"
)
QUESTION = (
    "id string, question string, answer string, company string, year string, quarter string, modality string, metric string, unit string, statement_type string, "
    "expected_numbers array<string>, expected_answer string, supporting_chunk_ids array<string>, supporting_documents array<string>, supporting_pages array<int>"
)


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunk files (JSON arrays) under root/company=*/year=*/quarter=*, with an explicit schema; partitions are pruned by filters."""
    rows = spark.read.schema(CHUNK + ", company string, year string, quarter string").option("multiLine", True).json(root)
    return rows.withColumn("text", F.coalesce("text", "embedding_text"))


def write_chunks(rows: DataFrame, root: str) -> None:
    rows.write.mode("overwrite").partitionBy("company", "year", "quarter").json(root)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Questions from files of one JSON array or several in a row; anything else, or no question, is an error."""

    def split(batches):
        import pyarrow as pa

        decoder = json.JSONDecoder()
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                at = 0
                while at < len(text):
                    if text[at].isspace():
                        at += 1
                        continue
                    part, at = decoder.raw_decode(text, at)
                    if not isinstance(part, list):
                        raise ValueError("ground truth must be arrays")
                    out += [json.dumps(x) for x in part]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["j"])

    rows = spark.read.text(path, wholetext=True).mapInArrow(split, "j string").select(F.from_json("j", QUESTION).alias("q")).select("q.*")
    if not rows.take(1):
        raise ValueError("no questions")
    return rows


#: Node label to (source_type, chunk_type).
LABELS = {"Chunk": ("pdf", "text"), "Table": ("pdf", "table"), "AudioChunk": ("audio", "audio")}


def with_label_kinds(nodes: DataFrame) -> DataFrame:
    """Adds source_type and chunk_type from ``label``; other or null labels are unknown."""
    kind = lambda i: F.coalesce(*[F.when(F.col("label") == k, v[i]) for k, v in LABELS.items()], F.lit("unknown"))
    return nodes.withColumn("source_type", kind(0)).withColumn("chunk_type", kind(1))


def by_kind(chunks: DataFrame) -> dict[str, DataFrame]:
    """The chunks of each type; a row of another type fails whichever table is read."""
    wrong = F.raise_error(F.concat(F.lit("unknown chunk_type: "), F.coalesce("chunk_type", F.lit("null"))))
    kinds = [k for _, k in LABELS.values()]
    return {kind: chunks.where(F.when(F.col("chunk_type").isin(*kinds), F.col("chunk_type") == kind).otherwise(wrong.cast("boolean"))) for kind in kinds}


def roster(quarters: DataFrame) -> DataFrame:
    """The distinct companies."""
    return quarters.where("company is not null").select("company").distinct()


def index_sizes(chunks: DataFrame, *keys: str) -> DataFrame:
    """Rows, those with a vector and those that wait for one, per ``keys`` or over all."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.count("embedding").alias("n_embedded"), F.count_if(F.expr("embedding_text is not null and embedding is null")).alias("n_pending"))


def read_summaries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of root/<experiment>/benchmark_summary.json with the experiment's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/benchmark_summary.json")
    return rows.withColumn("experiment", F.element_at(F.split(F.input_file_name(), "/"), -2))


def pending_embeddings(chunks: DataFrame) -> DataFrame:
    """Rows with text to embed and no vector yet."""
    return chunks.where("embedding_text is not null and embedding is null")


def resume(rows: DataFrame, done: DataFrame, keys=("question", "company", "quarter", "year")) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def json_rows(text):
    """Table rows kept as JSON; null where that is broken."""
    return F.from_json(text, "array<array<string>>")


def markdown_report(summary: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small summary (one row per bucket) as a Markdown table; more than ``most`` rows are no report and raise."""
    show = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = summary.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])


def merge_failures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Failed chunks by chunk_id; a later failure replaces the earlier one."""
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)
