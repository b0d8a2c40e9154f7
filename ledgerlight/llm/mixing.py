"""Mixing sources to target weights by entropy balancing.

DataFrame functions only. Each source has a token target. Among all document rates the balancing picks those nearest to 1
in relative entropy that meet the targets; its convex dual has one multiplier per source, and the rates are exponentially
tilted, rate = min(most, exp(multiplier * size / mean size of the source)). Newton iterations, bracketed so that they
cannot leave the root, solve the dual: each is one map-side combined aggregate over (source, size) cells, which hold the
corpus exactly and grow with the number of distinct sizes, not of documents. Sums are of whole numbers (rates in
millionths), so reruns agree to the bit.

Rates are rounded to copies: the whole part always, and one more for the documents with the smallest scattered number
over fraction (sequential Poisson order), as many as the source's target still asks for. That cut is found digit by
digit in histograms of 4096 cells per source, so no source is ever sorted or gathered in one task; two more turns fill
what is missing with documents that fit into it.

Nulls: a null text has size 0; null sources are one source, ordered last; a null doc_id is scattered by its size. Rows
that are equal get equal copies. Sources of size 0 get target 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rates are summed as whole numbers of this unit, so sums hang on no order and their error stays far below the tolerance.
_FINE = 10**12
_DIGITS, _BASE = 2, 4096
_TURNS = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): water filling of the weighted shares under caps.

    Ranks need one ordered pass over the distinct sources, which are few next to the documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = totals.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    # Sources fill up in the order of cap over weight; the level is that of the first point where the rest fits.
    turn = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    after = turn.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    ranked = ranked.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    ranked = ranked.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "k", "level"))).over(everything)["level"])
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def solve_rates(cells: DataFrame, targets: DataFrame, most: int = MOST, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """(source, multiplier, mean): Newton's method on the dual; ``cells`` are (source, size, n).

    The dual separates by source. A source that met its target to ``tolerance`` is frozen, and later rounds read the
    cells of the others only. Newton works on the logarithm of the taken size, which the tilt makes nearly straight; a
    step that leaves the bracket, or that did not halve the gap, is replaced by the bracket's middle, so each source is
    done in some 60 rounds at worst and raises where it is not. Sources whose target is 0 or their cap need no
    multiplier and are left out.
    """
    cells = cells.where("size > 0")
    own = cells.groupBy("source").agg(F.sum("n").alias("docs"), F.min("size").alias("least"), F.sum(F.col("size") * F.col("n")).alias("have"))
    own = own.withColumn("mean", F.col("have") / F.col("docs"))
    own = own.withColumnRenamed("source", "src").join(targets, F.col("src").eqNullSafe(F.col("source")))
    state = own.where((F.col("target") > 0) & (F.col("target") < most * F.col("have"))).select(
        "src", "target", "mean", F.log(F.col("target") / F.col("have")).alias("x"), F.lit(None).cast("double").alias("lo"),
        (math.log(most) * F.col("mean") / F.col("least")).alias("hi"), F.lit(None).cast("double").alias("gap"), F.lit(False).alias("done"),
    )
    state = materialize(state, "dual")
    z = F.col("size") / F.col("mean")
    rate = F.least(F.exp(F.least(F.col("x") * z, F.lit(5.0))), F.lit(float(most)))
    exact = lambda c: (F.round(c * _FINE).cast("decimal(20,0)") * F.col("size") * F.col("n")).cast("decimal(38,0)")
    kept = ["src", "target", "mean", "x", "lo", "hi", "gap"]
    for _ in range(rounds):
        live = state.where("not done").select(*kept)
        sums = cells.join(live, cells["source"].eqNullSafe(live["src"])).groupBy(*kept).agg(
            (F.sum(exact(rate)).cast("double") / _FINE).alias("got"),
            (F.sum(F.when(rate < most, (F.round(rate * z * 1000).cast("decimal(24,0)") * F.col("size") * F.col("n")).cast("decimal(38,0)"))).cast("double") / 1000).alias("slope"),
        )
        now = F.abs(F.col("got") / F.col("target") - 1)
        lo = F.when(F.col("got") < F.col("target"), F.col("x")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") >= F.col("target"), F.least("x", "hi")).otherwise(F.col("hi"))
        step = F.col("x") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (step < F.col("hi2")) & (F.col("lo2").isNull() | (step > F.col("lo2"))) & (F.col("gap").isNull() | (F.col("now") <= F.col("gap") / 2))
        middle = F.coalesce((F.col("lo2") + F.col("hi2")) / 2, F.least(2 * F.col("x"), F.col("x") - 1))
        nxt = sums.withColumns({"now": now, "lo2": lo, "hi2": hi})
        nxt = nxt.withColumn("next", F.when(F.col("now") <= tolerance, F.col("x")).when(inside, step).otherwise(middle))
        nxt = nxt.select("src", "target", "mean", F.col("next").alias("x"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("now").alias("gap"), (F.col("now") <= tolerance).alias("done"))
        state = materialize(nxt.union(state.where("done")), "dual")
        if not state.where("not done").take(1):
            return state.select(F.col("src").alias("source"), F.col("x").alias("multiplier"), "mean")
    raise RuntimeError(f"the dual did not converge in {rounds} rounds")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, n_copies) for each row of ``docs``."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = materialize(source_targets(sized.select("source", "size"), weights, most), "targets")
    cells = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    rates = solve_rates(cells, targets, most)
    per = targets.join(rates.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").withColumnRenamed("source", "src")
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    rate = F.least(F.exp(F.least(F.col("multiplier") * F.col("size") / F.nullif(F.col("mean"), F.lit(0.0)), F.lit(5.0))), F.lit(float(most)))
    rate = F.when((F.col("size") > 0) & (F.col("target") >= most * F.col("source_size")), F.lit(float(most))).when((F.col("size") > 0) & (F.col("target") <= 0), F.lit(0.0)).otherwise(rate)
    rows = rows.withColumn("rate", F.round(F.coalesce(rate, F.lit(1.0)), 6)).withColumn("whole", F.floor("rate").cast("long"))
    # The order in which fractions are filled, as a whole number of 24 bits.
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.col("size")), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    last = _BASE**_DIGITS - 1
    rows = rows.withColumn("q", F.when(F.col("rate") > F.col("whole"), F.least(F.floor(u / (F.col("rate") - F.col("whole")) / 64.0 * last), F.lit(last)).cast("long")))
    rows = materialize(rows, "rates")
    left = rows.groupBy("source", "target").agg((F.col("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    cut = materialize(left.select(F.col("source").alias("src"), F.greatest("need", F.lit(0.0)).alias("need")), "need")
    rows = rows.withColumn("extra", F.lit(0).cast("long"))
    for turn in range(_TURNS):  # after the first turn, documents that fit into what is still missing
        both = rows.join(cut, rows["source"].eqNullSafe(cut["src"]), "left").drop("src")
        may = F.col("q").isNotNull() & (F.col("size") > 0) & (F.col("extra") == 0)
        rows = materialize(both.withColumn("may", may & (F.lit(turn == 0) | (F.col("size") <= F.col("need")))).drop("need"), "rates")
        cut = materialize(_fill(rows.where("may").select("source", "size", "q"), cut, turn == _TURNS - 1), "need")
        taken = F.coalesce(F.col("may") & (F.col("q") < F.col("at")), F.lit(False)).cast("long")
        both = rows.join(cut, rows["source"].eqNullSafe(cut["src"]), "left")
        rows = both.withColumn("extra", F.col("extra") + taken).drop("src", "need", "at", "may")
        cut = cut.drop("at")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + F.col("extra")).alias("n_copies"))


def _fill(part: DataFrame, need: DataFrame, end: bool) -> DataFrame:
    """(src, at, need): each source takes its rows with q < at; need is what is missing then. At the end, the nearer side."""
    cut = need.withColumn("at", F.lit(0).cast("long"))
    for digit in range(_DIGITS):
        unit = _BASE ** (_DIGITS - 1 - digit)
        inside = part.join(cut, part["source"].eqNullSafe(cut["src"])).where(F.expr(f"q div {unit * _BASE} = at div {unit * _BASE}"))
        hist = inside.groupBy(F.col("src").alias("s2"), F.col("need").alias("n2"), F.expr(f"q div {unit}").alias("cell")).agg(F.sum("size").alias("tokens"))
        by = Window.partitionBy("s2", "n2").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("below", F.coalesce(F.sum("tokens").over(by), F.lit(0)))
        # Of the cells that begin before the need is met, the last; its inside is looked at with the next digit.
        found = hist.where("below < n2").groupBy("s2", "n2").agg(F.max(F.struct("cell", "below", "tokens")).alias("c")).drop("n2")
        nxt = cut.join(found, F.col("src").eqNullSafe(F.col("s2")), "left")
        whole = F.col("need") - F.col("c.below") >= F.col("c.tokens") / (2 if end else 1) if digit == _DIGITS - 1 else F.lit(False)
        at = F.when(F.col("c").isNull(), F.col("at")).otherwise((F.col("c.cell") + whole.cast("long")) * unit)
        used = F.coalesce(F.col("c.below") + F.when(whole, F.col("c.tokens")).otherwise(F.lit(0)), F.lit(0))
        cut = materialize(nxt.select("src", (F.col("need") - used).alias("need"), at.alias("at")), "cut")
    return cut


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it."""
    own = copies(docs.select("doc_id", "source", "text"), weights, most)
    # Equal (doc_id, source, size) get equal copies, so one row of each decides.
    times = own.groupBy("doc_id", "source", "size").agg(F.max("n_copies").alias("times"))
    # The rows travel as one struct, so no column of theirs can clash with the names used here.
    rows = docs.select(F.struct("*").alias("row"), word_count(F.col("text")).alias("size"))
    same = F.col("row.doc_id").eqNullSafe(times["doc_id"]) & F.col("row.source").eqNullSafe(times["source"]) & (rows["size"] == times["size"])
    rows = rows.join(times.where("times > 0"), same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select("row.*")


def op4_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    got = copies(docs)
    return got.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("n_copies") * F.col("size")).alias("taken"), "rate", "n_copies")
