"""Queries of this subpackage that have SQL, against it; and the SQL on odd rows, against plain programs."""

import duckdb
import pytest

from kinetable.llm import conversation_repair
from kinetable.llm import queries as llm
from tests.llm.test_conversation_repair import by_hand, odd_rows
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    problem, n = compare(llm.QUERIES[name](spark, SF), connect(SF), llm.ORACLES[name])
    assert problem is None


def test_repair_sql_on_odd_rows():
    rows, con = odd_rows(), duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(conversation_repair.oracle_sql()).fetchall()} == by_hand(rows)
