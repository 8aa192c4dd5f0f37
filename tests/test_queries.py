from __future__ import annotations

import duckdb
import pytest

from filmstrip.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    near = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(near(x) for x in r) for r in data), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(cols, [[r[c] for c in cols] for r in df.collect()])
    if name not in catalog.ORACLES:
        assert got
        return
    r = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == rows(cols, [[x[names.index(c)] for c in cols] for x in r.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in plan(catalog.distinct_bytes(spark, SF))
    gate = plan(catalog.classify_gate_lineitem(spark, SF))
    assert "Exchange" not in gate and "l_shipdate" not in gate
    assert "NestedLoop" not in plan(catalog.longest_prefix(spark, SF))


def test_probe_documents_are_parsed_once(spark):
    from filmstrip.plans import media

    assert plan(media.probe_documents(spark, SF)).count("from_json(") <= 2
    assert plan(media.probe_audio(spark, SF)).count("from_json(") == 1
