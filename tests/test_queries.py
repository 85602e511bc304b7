"""Registered queries beside their SQL on the smallest tables; the driver compares them at sf0.01."""

import os

import pytest
from oracle import connection, difference

from loam import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    assert not difference(spark, connection(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
