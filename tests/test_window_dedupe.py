"""The window over copies: one pass for all groups, the same rows as a fold of each."""

import random

from pyspark.sql import functions as F

from ledgerlight.operators import chunking as C


def test_folds_stream(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice([None, *range(12)]), i, rng.choice(["a", " a", "b\n", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc long, page long, pos long, text string")
    want, last = set(), {}
    for doc, page, pos, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        key, at = (doc, text and text.strip()), float("nan") if page is None else page
        if key not in last or at - last[key] > 3:
            last[key] = at
            want.add(pos)
    got = C.window_dedupe(df)
    assert {r.pos for r in got.collect()} == want
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString() and got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
