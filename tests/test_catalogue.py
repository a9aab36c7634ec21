"""Every query of the catalogue on the smallest tables, beside its SQL."""

import math

import duckdb
import pytest

from corpusmill.plans import indexes, monitoring, service  # noqa: F401  these add their queries
from corpusmill.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert found.count() > 0
        return
    want = duck.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted(repr([plain(x) for x in r]) for r in found.select(*(f"`{c}`" for c in columns)).collect())
    assert rows == sorted(repr([plain(x) for x in r]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
