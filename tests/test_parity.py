"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import os

import parity
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return parity.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    problem = parity.compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None


def test_every_query_has_an_expected_result():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    optional = set(entry._llm_queries())  # tested in their own folder where SQL cannot express them
    assert set(entry.queries()) - optional == set(entry.oracle_sql()) - optional


def test_entry(spark):
    assert entry.entry(spark).count() > 0
