"""Registered queries against their SQL oracles at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = ("AGG08", "AGG12", "AGG16", "AGG17", "AGG20", "SNK03", "SNK04", "SNK09", "AGG22", "EPI11", "EPI13", "EPI18", "JON02", "JON05", "JON06", "PRJ13", "SET02", "SNK06", "WIN04", "WIN09")
IDS = sorted(entry.oracle_sql()) if os.environ.get("ALL_ORACLES") else QUICK


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", IDS)
def test_oracle(spark, name):
    problem, _ = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "priority_key" in df.columns
