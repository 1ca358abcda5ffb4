"""Every registered query with SQL against DuckDB, on the smallest tables."""
import glob
import os

import duckdb
import pytest

from skein import plans

SF = os.environ.get("SKEIN_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    names = sorted(df.columns)
    return names, sorted(map(repr, df[names].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, db, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(db.execute(plans.oracle_sql()[name]).df())


def test_the_rest_has_tests_of_its_own():
    from tests import test_invariants

    assert set(plans.queries()) - set(plans.oracle_sql()) == {n.removeprefix("test_") for n in dir(test_invariants) if n.removeprefix("test_") in plans.queries()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
