"""Where a piece of evidence comes from: exact containment by seeds, and the longest common block."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

SEED = 4
#: Items that one reading of the texts may search without a seed.
BLOCK = 1_000


def _with_grams(rows: DataFrame, text: str, inner: bool) -> DataFrame:
    """Adds ``grams``: hashes of all runs of SEED tokens; ``inner`` leaves out the first and last token, which may be parts of
    longer ones. Each step is a column of its own, so nothing is computed once per element."""
    rows = rows.withColumn("h_", F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)))
    if inner:
        rows = rows.withColumn("h_", F.expr("slice(h_, 2, greatest(size(h_) - 2, 0))"))
    rows = rows.withColumn("g_", F.expr("zip_with(h_, slice(h_, 2, greatest(size(h_), 1)), (a, b) -> xxhash64(a, b))"))
    pairs = "zip_with(g_, slice(g_, 3, greatest(size(g_), 1)), (a, b) -> xxhash64(a, b))"
    return rows.withColumn("grams", F.expr(f"slice({pairs}, 1, greatest(size(h_) - {SEED - 1}, 0))")).drop("h_", "g_")


def exact_sources(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id, ...) of texts that contain an item's ``evidence``, letter by letter.

    A seed, one run of tokens from inside the evidence, stands in every text that contains it; texts are joined to items on
    seeds by equality and then compared. Items too short for a seed are compared with every text, in blocks.
    """
    seeded = _with_grams(items, "evidence", True).withColumn("seed", F.array_min("grams")).drop("grams")
    keyed = seeded.where("seed is not null")
    spread = _with_grams(texts, "text", False).select(*texts.columns, F.explode_outer(F.array_distinct("grams")).alias("seed"))
    rows = spread.join(keyed.select("seed").distinct(), "seed", "left_semi")
    out = rows.join(keyed, "seed").where(F.col("text").contains(F.col("evidence"))).drop("seed")
    short = seeded.where("seed is null").drop("seed")
    blocks = -(-short.count() // BLOCK)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item_id", "evidence"), F.lit(blocks)) == k)
        out = out.unionByName(texts.join(block, F.col("text").contains(F.col("evidence"))))
    return out


def longest_block(a: str, b: str) -> int:
    """Length of the longest common substring, by the suffix automaton of ``a``."""
    step: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for ch in a:
        now = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = now
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    best = have = at = 0
    for ch in b:
        while at and ch not in step[at]:
            at = link[at]
            have = size[at]
        if ch in step[at]:
            at = step[at][ch]
            have += 1
        best = max(best, have)
    return best


def best_sources(items: DataFrame, chunks: DataFrame, least: float = 0.4, shortest: int = 8) -> DataFrame:
    """(item_id, chunk_id, share): of the chunks of an item's quarter, the first that contains its evidence, else the one with the
    longest common block, if that is ``least`` of the evidence or more. Case and white space are of no account; evidence under
    ``shortest`` characters has no source. Chunks are read by quarter, one pair of texts at a time."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    asked = items.where(F.length(F.trim("evidence")) >= shortest).select("item_id", "quarter_id", F.trim(flat(F.col("evidence"))).alias("evidence"))
    pairs = asked.join(chunks.where("text <> ''").select("quarter_id", "chunk_id", flat(F.col("text")).alias("text")), "quarter_id")
    whole = F.col("text").contains(F.col("evidence"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, chunk_ids, evidence, text = (c.to_pylist() for c in batch.columns)
            share = [longest_block(a, b) / len(a) for a, b in zip(evidence, text, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chunk_ids, pa.int64()), pa.array(share, pa.float64())], ["item_id", "chunk_id", "share"])

    exact = pairs.where(whole).groupBy("item_id").agg(F.min("chunk_id").alias("chunk_id")).withColumn("share", F.lit(1.0))
    rest = pairs.join(exact.select("item_id"), "item_id", "left_anti").select("item_id", "chunk_id", "evidence", "text")
    found = rest.mapInArrow(score, "item_id long, chunk_id long, share double").where(F.col("share") >= least)
    best = found.groupBy("item_id").agg(F.max(F.struct("share", -F.col("chunk_id"))).alias("b")).select("item_id", (-F.col("b")["col2"]).alias("chunk_id"), F.col("b.share").alias("share"))
    return exact.unionByName(best)
