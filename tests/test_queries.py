"""Every query of the library against its SQL on the smallest tables."""

import pytest

from tideline.plans import containers, matching, media, relational

from .oracle import DATA, database, same_rows

QUERIES = matching.QUERIES | relational.QUERIES | media.QUERIES | containers.QUERIES
ORACLE_SQL = matching.ORACLE_SQL | relational.ORACLE_SQL | media.ORACLE_SQL | containers.ORACLE_SQL
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    same_rows(QUERIES[name](spark, str(DATA)), db, ORACLE_SQL[name])


def test_resetting_windows_over_all_events(spark, db):
    got = QUERIES["resetting_windows"](spark, str(DATA)).select("user_id").collect()
    assert sorted(r.user_id for r in got) == sorted(u for (u,) in db.execute("SELECT user_id FROM events").fetchall())


def test_chunk_offsets_over_all_orders(spark, db):
    got = QUERIES["chunk_offsets"](spark, str(DATA)).select("k").distinct().collect()
    assert sorted(r.k for r in got) == sorted(k for (k,) in db.execute("SELECT DISTINCT l_orderkey FROM lineitem").fetchall())


def test_coverage_has_rows_to_find(spark):
    assert QUERIES["coverage_anti"](spark, str(DATA)).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()
    assert e.entry(spark).filter("outcome = 'Identified'").count() == 1
