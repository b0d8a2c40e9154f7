"""Column anchors: the SQL's place for missing and negative edges, and equal edges in one run."""

import random

import duckdb

from ledgerlight.operators import chunking as C
from ledgerlight.plans.queries import ORACLE_SQL, QUERIES

SCHEMA = "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string"
#: No edge twice on a page but missing ones, so the SQL leaves no tie open.
PRICES = {1: [10.0, 12.0, 14.0, 300.0, None, None, None], 2: [-0.5, -30.25, 700.0, None], 3: [None, None], 4: [5.0]}


def test_odd_edges_equal_sql(spark, tmp_path):
    """F8: missing edges were counted in the first run, negative ones rounded toward zero."""
    rows = [(10 * doc + i, doc, 1, x, float(i), "R") for doc, xs in PRICES.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    cur = duck.execute(ORACLE_SQL["q_column_anchors"])
    cols = [d[0] for d in cur.description]
    got = sorted(map(repr, (tuple(r) for r in QUERIES["q_column_anchors"](spark, str(tmp_path)).select(*cols).collect())))
    assert got == sorted(map(repr, cur.fetchall()))


def test_equal_edges_share_a_run(spark):
    rng = random.Random(8)
    rows = [(doc, 0, float(rng.choice([0, 5, 23, 24, 42, 43, 100, 119]))) for doc in range(30) for _ in range(rng.randrange(1, 60))]
    want = set()
    for doc in range(30):
        runs = []
        for x in sorted(x for d, _, x in rows if d == doc):
            if runs and x - runs[-1][-1] <= 18:
                runs[-1].append(x)
            else:
                runs.append([x])
        kept = [r for r in runs if len(r) >= 0.3 * max(map(len, runs))]
        want |= {(doc, 0, i, round(sum(r) / len(r), 9)) for i, r in enumerate(kept)}
    got = C.column_anchors(spark.createDataFrame(rows, "doc long, page long, x1 double").repartition(7))
    assert {(r.doc, r.page, r.anchor_no, round(r.anchor, 9)) for r in got.collect()} == want
    assert "RangeFrame" in got._jdf.queryExecution().optimizedPlan().toString()
