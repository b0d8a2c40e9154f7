"""Every query of the engine's own suite equals its SQL."""

import duckdb
import pytest

from ledgerlight.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fastrp_has_the_production_dimensions(spark, sf):
    assert len(QUERIES["q_fastrp"](spark, sf).first()["vec"]) == 128
