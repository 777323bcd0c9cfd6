"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def _optional(name):
    """Queries on training text, whose tests are elsewhere; some cannot be told in SQL."""
    return name == "pipeline" or re.match(r"op\d+_", name)


def test_all_queries_have_sql():
    assert {n for n in entry.queries() if not _optional(n)} == {n for n in entry.oracle_sql() if not _optional(n)}


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
