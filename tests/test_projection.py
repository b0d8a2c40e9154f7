"""Random projection: equal to plain sums over neighbours, and planned without a row per dimension."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlight.operators import graph as G


def test_fast_rp_moves_vectors_not_entries(spark):
    rng = random.Random(7)
    pairs = [("hub", f"p{i}") for i in range(40)] + [(f"s{rng.randrange(6)}", f"p{rng.randrange(40)}") for _ in range(90)] + [("x", "y"), ("z", "z"), (None, "x"), ("p1", "hub")]
    edges, dim, weights = spark.createDataFrame(pairs, "src string, dst string"), 8, (0.5, 1.0, 1.0, 0.5)
    near = {}
    for a, b in pairs:
        if a and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    start = spark.createDataFrame([(n,) for n in near], "node string").select("node", F.array(*[F.pmod(F.xxhash64("node", F.lit(i), F.lit(42)), F.lit(6)) for i in range(dim)]).alias("u"))
    now = {r.node: np.array([3**0.5 if u == 0 else -(3**0.5) if u == 1 else 0.0 for u in r.u]) for r in start.collect()}
    want = {n: np.zeros(dim) for n in near}
    for w in weights:
        for n, v in now.items():
            want[n] += w * v / (np.sqrt(v @ v) or 1.0)
        now = {n: sum(now[m] for m in near[n]) / len(near[n]) for n in near}
    out = G.fast_rp(edges, dim, weights, buckets=3)
    got = {r.node: r.vec for r in out.collect()}
    assert all(np.allclose(want[n], got.get(n, np.zeros(dim))) for n in near) and set(got) <= set(near)
    assert "sequence(0" not in out._jdf.queryExecution().toString()
