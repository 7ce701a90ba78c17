"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest
from oracle import connect, difference

from checks import REGISTRY

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    entry = REGISTRY[name]
    df = entry.run(spark, SF_DIR)
    if entry.sql:
        assert difference(df, duck, entry.sql) is None
    else:
        assert df.columns and df.count() >= 0


def test_every_query_has_sql():
    assert [n for n, e in REGISTRY.items() if not e.sql] == []
