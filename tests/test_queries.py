"""Every registered query of the engine against its SQL, and the entry module."""

import pytest

import __spark_entry__ as entry
from basinforge.plans import registry
from oracle import TINY, database, same_rows


@pytest.fixture(scope="module")
def con():
    return database(TINY)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    ours = registry.QUERIES[name](spark, TINY).toPandas()
    if name in registry.ORACLE_SQL:
        same_rows(ours, con.execute(registry.ORACLE_SQL[name]).fetchdf())
    else:
        assert len(ours)


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "basin", "p", "n_states"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
