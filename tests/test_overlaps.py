"""Overlap scores are counted once a row, outside of nested expressions; short, empty and null arrays keep their values."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import metrics as M
from ledgerlight.plans.queries import QUERIES


def test_scores_of_odd_arrays(spark):
    rows = [(1, ["a"], ["a"]), (2, [], ["a"]), (3, [], []), (4, None, ["a"]), (5, ["a", None, "b"], ["a", "b"]), (6, ["a", "b", "a", "b"], ["b", "a", "b"])]
    p, g = F.col("p"), F.col("g")
    df = spark.createDataFrame(rows, "i int, p array<string>, g array<string>").select("i", M.rouge_n(p, g, 1).alias("r1"), M.rouge_n(p, g, 2).alias("r2"), M.rouge_l(p, g).alias("l"), M.bleu(p, g).alias("b"))
    got = {r.i: r for r in df.collect()}
    assert tuple(got[1])[1:4] == (1.0, 1.0, 1.0) and got[2].r1 is None and got[2].l is None and got[2].b is None
    assert got[2].r2 == 0.0 and got[3].r2 == 1.0 and got[4].r1 is None and got[4].r2 == 0.0
    assert got[5].r1 == pytest.approx(0.8) and got[5].l == pytest.approx(0.8) and got[5].r2 == 0.0
    assert got[6].l == pytest.approx(6 / 7) and got[6].r2 == pytest.approx(4 / 5)


def test_conversations_are_scored_in_several_tasks_and_once(spark, sf):
    df = QUERIES["q_overlap_scores"](spark, sf)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
