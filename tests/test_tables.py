"""Every query over the given tables agrees with its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as spark_entry
import check
from tablequeries.oracles import ORACLES, WITHOUT_SQL
from tablequeries.queries import QUERIES
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return check.database(DATA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert check.differences(spark, connection, DATA, name) is None


def test_each_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES) and set(QUERIES) >= WITHOUT_SQL
    assert set(QUERIES) <= set(spark_entry.queries()) and set(ORACLES) <= set(spark_entry.oracle_sql())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["custom_id", "request"] and df.count() > 0
