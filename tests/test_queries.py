"""Every query with SQL, on the smallest tables; the others run and give rows."""

from __future__ import annotations

import pytest

from inkstrata import oracles, queries

from .compare import database, same

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    same(queries.queries()[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_does_not_import_llm():
    from pathlib import Path

    for p in Path(queries.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm import" not in p.read_text() and "import llm" not in p.read_text(), p
