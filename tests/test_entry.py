"""Every registered query against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from starpipe.catalog.oracles import ORACLES
from starpipe.catalog.registry import QUERIES
from tests.oracle_check import compare, connect


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    problem = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert problem is None
