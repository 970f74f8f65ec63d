"""Every query against its SQL on the smallest tables; those without SQL must at least run."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.parity import compare

PATH = os.environ.get("DOCWEFT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    ok, say = compare(spark, PATH, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, say


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, PATH)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
