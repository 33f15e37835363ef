"""Each registered query against its SQL on the smallest tables, as sorted rows."""

import math

import duckdb
import pytest

from disfluo.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in registry.ORACLES:
        assert rows
        return
    want = con.sql(registry.ORACLES[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(shown(r[c]) for c in cols) for r in rows) == sorted(tuple(shown(r[k]) for k in at) for r in want.fetchall())


def test_names_without_the_training_data_part(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
