"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import SMALL
from helpers import duck_rows, rows_of

import __spark_entry__ as contract

QUERIES = {name: q for name, q in contract.queries().items() if name.startswith("q_")}
SQL = {name: q for name, q in contract.oracle_sql().items() if name.startswith("q_")}


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert contract.entry(spark).count() == 67


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    columns, got = rows_of(QUERIES[name](spark, SMALL))
    expected_columns, expected = duck_rows(duck, SQL[name])
    assert columns == expected_columns
    assert got == expected


def test_marks_disagree_both_ways(spark):
    rows = QUERIES["q_qc_solution_consistency"](spark, SMALL).collect()
    assert {(r.resolved, r.solved) for r in rows} == {(True, False), (False, True)}
