"""Every registered query against its SQL on the smallest tables."""

import math

import pytest

from lumicat import queries as catalog
from lumicat.plans.tables import PIXELS, table

from .compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        assert difference(df, con, catalog.ORACLE_SQL[name]) == ""
    else:
        rows = df.collect()
        assert rows and not any(isinstance(v, float) and not math.isfinite(v) for r in rows for v in r)
        if {"frame", "y", "x"} <= set(df.columns):  # one row for each pixel, and something happened to them
            assert len({(r.frame, r.y, r.x) for r in rows}) == len(rows) == table(spark, sf_dir, PIXELS).count()
            assert len({tuple(v for k, v in r.asDict().items() if k not in ("frame", "y", "x")) for r in rows}) > 10


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
