"""From pages and calls to chunks: cleaning, carry-forward, splitting and merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated_edges(blocks: DataFrame) -> DataFrame:
    """(doc, page, pos, text) without texts that open or close at least max(2, pages // 2) pages of the document."""
    w = Window.partitionBy("doc", "page")
    rows = blocks.withColumn("edge_", (F.col("pos") == F.min("pos").over(w)) | (F.col("pos") == F.max("pos").over(w)))
    seen = rows.where("edge_").groupBy("doc", "text").agg(F.count_distinct("page").alias("n_"))
    pages = blocks.groupBy("doc").agg(F.count_distinct("page").alias("pages_"))
    bad = seen.join(pages, "doc").where(F.col("n_") >= F.greatest(F.lit(2), F.floor(F.col("pages_") / 2))).select("doc", "text")
    return rows.drop("edge_").join(bad, ["doc", "text"], "left_anti")


def carry_forward(rows: DataFrame, column: str, keys: list[str], order: list[str], default: str = "Unknown") -> DataFrame:
    """The last non-null value so far, first ``default``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(w), F.lit(default)))


def heading_groups(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Numbers the runs that begin with a heading (column ``is_heading``)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group_no", F.sum(F.col("is_heading").cast("int")).over(w))


def window_dedupe(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """Drops a block whose text, white space at its ends aside, was kept within the last ``pages`` pages; dropped copies do not
    renew the mark. Headings (a column ``is_heading``, if there is one) all stay.

    Rows stream past in the order of document, text and page, so no group is held, and none costs a call of its own.
    """
    columns, schema = blocks.columns, blocks.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for doc, text, page in zip(batch["doc"].to_pylist(), batch["plain_"].to_pylist(), batch["page"].to_pylist(), strict=True):
                if (doc, text) != now:
                    now, last = (doc, text), None
                page = float("nan") if page is None else page
                ok = last is None or page - last > pages
                keep.append(ok)
                last = page if ok else last
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    def body(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("plain_", F.regexp_replace("text", r"^\s+|\s+$", ""))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ["doc", "plain_", F.col("page").asc_nulls_last(), F.col("pos").asc_nulls_last()]
        return rows.repartition(parts, "doc", "plain_").sortWithinPartitions(*order).mapInArrow(fold, schema)

    if "is_heading" not in blocks.columns:
        return body(blocks)
    return blocks.where("is_heading").unionByName(body(blocks.where("not coalesce(is_heading, false)")))


def _split(text: str, limit: int, carry: int) -> list[str]:
    if len(text) <= limit:
        return [text]
    out, now = [], ""
    for line in filter(None, map(str.strip, text.split("\n"))):
        if len(now) + len(line) >= limit:
            out.append(now.strip())
            now = now[-carry:] if carry else ""
        now = f"{now}\n{line}"
    return [*out, now.strip()] if now else out


def _split_large(text: str, limit: int) -> list[str]:
    out = []
    while len(text) > limit:
        at = next((k for k in (text.rfind("\n\n", 0, limit), text.rfind("\n", 0, limit)) if k >= limit * 0.5), limit)
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text.strip() or not out else out


def _pieces(rows: DataFrame, cut) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, p) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, p in enumerate(cut(t or ""))]
            yield pd.DataFrame(out, columns=["id", "seq", "text"])

    return rows.select("id", "text").mapInPandas(run, "id long, seq int, text string")


def split_text(rows: DataFrame, limit: int = 1200, carry: int = 200) -> DataFrame:
    """(id, text) -> (id, seq, text): a text within the limit whole, else its lines gathered greedily, each piece led by the end
    of the one before. A line over the limit is not cut; an empty first piece, as before such a line, is left to the filters."""
    return _pieces(rows, lambda t: _split(t, limit, carry))


def split_large(rows: DataFrame, limit: int) -> DataFrame:
    """(id, text) -> (id, seq, text): pieces of at most ``limit`` that give back the text, cut at the last blank line or else the
    last line's end in their second half, or else at the limit; white space alone makes no last piece."""
    return _pieces(rows, lambda t: _split_large(t, limit))


def merge_segments(rows: DataFrame, soft: int = 350, hard: int = 700) -> DataFrame:
    """(call, seq, start, end, text) -> merged segments: two or more, closed where the merged text ends a sentence from ``soft``
    words on, or at ``hard`` words; from the first one's start to the last one's end. Texts should be cleaned before."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for seq, start, end, text in pdf.sort_values("seq")[["seq", "start", "end", "text"]].itertuples(index=False):
            words = len((text or "").split())
            if now is None:
                now = [seq, start, end, [text or ""], words]
                continue
            now[2] = end
            now[3].append(text or "")
            now[4] += words
            if now[4] >= hard or now[4] >= soft and " ".join(now[3]).rstrip().endswith((".", "?", "!")):
                out.append(now)
                now = None
        done = [*out, now] if now else out
        return pd.DataFrame([(pdf["call"].iloc[0], s, a, b, " ".join(t)) for s, a, b, t, _ in done], columns=["call", "seq", "start", "end", "text"])

    return rows.groupBy("call").applyInPandas(fold, "call long, seq long, start double, end double, text string")


def first_copies(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each stripped text within ``keys``."""
    w = Window.partitionBy(*keys, F.regexp_replace("text", r"^\s+|\s+$", "")).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Numbers the blocks of a page from top to bottom, then left to right; those without a box come last."""
    w = Window.partitionBy("doc", "page").orderBy(F.col("y").asc_nulls_last(), F.col("x").asc_nulls_last(), "id")
    return blocks.withColumn("pos", F.row_number().over(w))


def column_anchors(words: DataFrame, gap: float = 18.0, least: float = 0.3) -> DataFrame:
    """(doc, page, anchor_no, anchor): right edges (doc, page, x1) in runs without a gap, the mean of each run that has at least
    ``least`` of the largest one's edges. Anchors are numbered from the left; words without an edge count in the last run.

    Gaps are added up by range, so equal edges share a run in whatever order they come."""
    page = Window.partitionBy("doc", "page")
    edges = page.orderBy(F.col("x1").asc_nulls_last())
    new = F.coalesce((F.col("x1") - F.lag("x1").over(edges) > gap).cast("int"), F.lit(0))
    runs = words.withColumn("new_", new).withColumn("run_", F.sum("new_").over(edges.rangeBetween(Window.unboundedPreceding, 0)))
    sums = runs.groupBy("doc", "page", "run_").agg(F.count("*").alias("n_"), F.avg("x1").alias("anchor"))
    kept = sums.withColumn("most_", F.max("n_").over(page)).where(F.col("n_") >= least * F.col("most_"))
    return kept.withColumn("anchor_no", F.row_number().over(page.orderBy("run_")) - 1).select("doc", "page", "anchor_no", "anchor")


def to_anchors(words: DataFrame, anchors: DataFrame, gap: float = 18.0) -> DataFrame:
    """(doc, page, line, anchor_no, value): each word (doc, page, line, x1, value) in the column of its nearest anchor, the left one
    on ties. Words over 1.5 gaps away are dropped, and a cell that two words claim stays empty. Anchors are few per page."""
    own = anchors.groupBy("doc", "page").agg(F.collect_list(F.struct("anchor", "anchor_no")).alias("all_"))
    near = F.array_min(F.transform("all_", lambda a: F.struct(F.abs(a["anchor"] - F.col("x1")).alias("far"), a["anchor_no"].alias("no"))))
    rows = words.join(own, ["doc", "page"]).withColumn("n_", near).where(F.col("n_.far") <= 1.5 * gap)
    cells = rows.groupBy("doc", "page", "line", F.col("n_.no").alias("anchor_no")).agg(F.count("*").alias("k_"), F.min("value").alias("value"))
    return cells.where("k_ = 1").drop("k_")


def page_text(chunks: DataFrame) -> DataFrame:
    """(doc, page, pos, text) -> the page's texts in order, as one."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return chunks.groupBy("doc", "page").agg(F.array_join(F.transform(packed, lambda x: x["text"]), " ").alias("page_text"))


def nearest_above(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each table (doc, page, table_id, top) the nearest text block (doc, page, bottom, text) above it."""
    near = tables.join(blocks, ["doc", "page"]).where("bottom <= top")
    return near.groupBy("doc", "page", "table_id").agg(F.min_by("text", F.struct(F.col("top") - F.col("bottom"), "text")).alias("title"))
