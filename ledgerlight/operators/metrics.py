"""Scores of answers and of retrieval, and their summaries."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Fixed value: the domain's words.
TERMS = (
    "revenue", "operations", "profit", "loss", "ebitda", "eps", "earnings", "margin", "income", "expense", "expenses", "tax", "interest", "crore", "lakh", "million",
    "billion", "consolidated", "standalone", "quarter", "quarterly", "annual", "fiscal", "year", "yoy", "qoq", "sequential", "segment", "guidance", "outlook",
    "dividend", "assets", "liabilities", "equity", "cash", "flow", "npa", "aum", "disbursement", "borrower", "growth", "decline", "increase", "decrease", "net",
    "gross", "total",
)


def jaccard(a: Column, b: Column) -> Column:
    """Null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def hit(retrieved: Column, truth: Column) -> Column:
    return F.when(F.size(truth) > 0, F.arrays_overlap(retrieved, truth).cast("int"))


def recall(retrieved: Column, truth: Column) -> Column:
    return F.when(F.size(truth) > 0, F.size(F.array_intersect(retrieved, truth)) / F.size(F.array_distinct(truth)))


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    """One over the rank of the first hit, 0 without any."""
    first = F.array_min(F.filter(F.transform(F.array_distinct(truth), lambda t: F.array_position(retrieved, t)), lambda p: p > 0))
    return F.coalesce(1.0 / first, F.lit(0.0))


def context_precision(retrieved: Column, truth: Column) -> Column:
    return F.when(F.size(retrieved) > 0, F.size(F.array_intersect(retrieved, truth)) / F.size(retrieved))


def terms(text: Column, vocabulary: tuple[str, ...] = TERMS) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: w.isin(*vocabulary)))


def term_precision(answer: Column, truth: Column) -> Column:
    """Of the domain's words in the answer, the share that the truth has; null without any."""
    own = terms(answer)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, terms(truth))) / F.size(own))


def source_type_accuracy(modality: Column, types: Column) -> Column:
    """Whether the retrieved source types cover the question's modality (pdf, audio or pdf+audio); null for others or nothing retrieved."""
    low = F.transform(types, lambda t: F.lower(F.coalesce(t, F.lit(""))))
    has = lambda t: F.array_contains(low, t)
    ok = F.when(modality == "pdf", has("pdf")).when(modality == "audio", has("audio")).when(modality == "pdf+audio", has("pdf") & has("audio"))
    return F.when(F.size(types) > 0, ok.cast("double"))


def page_recall(retrieved_pages: Column, truth_pages: Column) -> Column:
    """Recall by page, for questions without chunk ids."""
    return recall(retrieved_pages, truth_pages)


def source_hits(ids: Column, places: Column, truth_ids: Column, truth_docs: Column, truth_pages: Column) -> tuple[Column, Column]:
    """(hit, recall) that also credit a chunk of an annotated document and page. ``places`` is array<struct<doc, page>>; documents
    agree where one name, without its ending, lies within the other. Null without annotation."""
    bare = lambda d: F.regexp_replace(F.lower(F.coalesce(d, F.lit(""))), r"\.[a-z0-9]+$", "")
    pages = F.array_distinct(truth_pages)
    targets = F.flatten(F.transform(F.array_distinct(F.transform(truth_docs, bare)), lambda d: F.transform(pages, lambda p: F.struct(d.alias("doc"), p.alias("page")))))
    same = lambda t, r: (t["page"] == r["page"]) & (r["doc"] != "") & (bare(r["doc"]).contains(t["doc"]) | t["doc"].contains(bare(r["doc"])))
    met = F.size(F.filter(targets, lambda t: F.exists(places, lambda r: F.coalesce(same(t, r), F.lit(False)))))
    hits = F.size(F.array_intersect(ids, truth_ids)) + met
    total = F.size(F.array_distinct(truth_ids)) + F.size(targets)
    return F.when(total > 0, (hits > 0).cast("double")), F.when(total > 0, F.least(F.lit(1.0), hits / total))


def mean_scores(retrieved: DataFrame, scores: list[str]) -> DataFrame:
    """Mean of each score per question over the chunks that have it."""
    return retrieved.groupBy("question_id").agg(*[F.avg(c).alias(f"avg_{c}") for c in scores])


def chunk_statistics(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks by type per key."""
    kinds = ("text", "table", "audio")
    return chunks.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in kinds])


def failure_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many rows each test caught, and how many none did."""
    clean = None
    for test in flags.values():
        clean = ~F.coalesce(test, F.lit(False)) if clean is None else clean & ~F.coalesce(test, F.lit(False))
    return rows.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in flags.items()], F.count_if(clean).alias("kept"))


def bucket_summary(rows: DataFrame, bucket: str, columns: list[str]) -> DataFrame:
    """Means per bucket and over all (a one-key rollup in one pass); nulls are skipped, booleans count 0 or 1."""
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in columns]
    out = rows.rollup(bucket).agg(F.grouping(bucket).alias("all_"), F.count("*").alias("n"), *means)
    return out.withColumn(bucket, F.when(F.col("all_") == 1, "ALL").otherwise(F.col(bucket))).drop("all_")


def merge_reports(left: DataFrame, right: DataFrame, bucket: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Two summaries side by side per bucket; buckets of one side stay. ``rename`` maps the right side's columns."""
    return left.join(right.withColumnsRenamed(rename or {}), bucket, "full_outer")


def throughput(latency: Column) -> Column:
    return 1 / F.nullif(latency, F.lit(0.0))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def _hits(pred: list | None, truth: list | None, n: int, least: int = 0) -> int:
    """Clipped count of common n-grams, nulls left out of the joined words; ``least`` n-grams are taken of any array."""
    if pred is None or truth is None:
        return 0
    grams = lambda t: Counter(" ".join(w for w in t[i : i + n] if w is not None) for i in range(max(len(t) - n + 1, least)))
    return (grams(pred) & grams(truth)).total()


def _words(pred: list | None, truth: list | None) -> int:
    given = lambda t: Counter(w for w in t or [] if w is not None)
    return (given(pred) & given(truth)).total()


def _common(pred: list | None, truth: list | None) -> int:
    """Length of the longest common subsequence: a bit per word of ``pred``, whose zeros count the matches."""
    if not pred or not truth:
        return 0
    at: dict = {}
    for i, w in enumerate(pred):
        if w is not None:
            at[w] = at.get(w, 0) | 1 << i
    whole = (1 << len(pred)) - 1
    row = whole
    for w in truth:
        use = row & at.get(w, 0)
        row = (row + use | row - use) & whole
    return len(pred) - row.bit_count()


def _overlaps(pred: Column, truth: Column, orders: int = 4) -> Column:
    """array of int: clipped n-grams of each order, those from order 2 on with short arrays whole, the common subsequence, clipped
    words without nulls. Equal calls are one."""

    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        pairs = zip(p.to_pylist(), g.to_pylist(), strict=True)
        return pa.array([[*(_hits(a, b, n) for n in range(1, orders + 1)), *(_hits(a, b, n, 1) for n in range(2, orders + 1)), _common(a, b), _words(a, b)] for a, b in pairs], pa.list_(pa.int32()))

    return F.arrow_udf(run, ArrayType(IntegerType()))(pred, truth)


def rouge_n(pred: Column, truth: Column, n: int = 1) -> Column:
    """F1 of clipped n-gram counts between two token arrays."""
    size = lambda t: F.size(t) if n == 1 else F.greatest(F.size(t) - n + 1, F.lit(1))
    orders = max(n, 4)
    both = _overlaps(pred, truth, orders)[2 * orders if n == 1 else orders + n - 2]
    return F.when((size(pred) > 0) & (size(truth) > 0), 2.0 * both / (size(pred) + size(truth)))


def rouge_l(pred: Column, truth: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays; null where one is empty."""
    return F.when((F.size(pred) > 0) & (F.size(truth) > 0), 2.0 * _overlaps(pred, truth)[7] / (F.size(pred) + F.size(truth)))


def bleu(pred: Column, truth: Column, orders: int = 4, epsilon: float = 0.1) -> Column:
    """Sentence BLEU of two token arrays: geometric mean of clipped n-gram precisions, an order without a match counted as
    ``epsilon``, with the brevity penalty; 0 without a common word, null where one is empty."""
    hits, logs = _overlaps(pred, truth, orders), F.lit(0.0)
    for n in range(1, orders + 1):
        logs = logs + F.log(F.when(hits[n - 1] > 0, hits[n - 1].cast("double")).otherwise(epsilon) / F.greatest(F.size(pred) - n + 1, F.lit(1))) / orders
    brevity = F.when(F.size(pred) >= F.size(truth), 0.0).otherwise(1 - F.size(truth) / F.size(pred))
    return F.when((F.size(pred) > 0) & (F.size(truth) > 0), F.when(hits[0] == 0, 0.0).otherwise(F.exp(logs + brevity)))
