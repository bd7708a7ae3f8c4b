"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = entry.SMALL
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_entry_is_stable(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0


def test_only_training_data_queries_lack_a_twin():
    """The numbered operators that SQL cannot express are held against brute force in their own tests."""
    assert {name for name in set(QUERIES) - set(ORACLES) if not re.match(r"op\d+_|pipeline$", name)} == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(frame, connection, ORACLES[name]) is None
    else:
        assert frame.count() > 0
