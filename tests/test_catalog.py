"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lumentick.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(df):
    """Rows as text; long columns with nulls come as doubles from one engine, as integers from the other."""
    plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", ["feed_time_series", "feed_as_of", "history_range", "history_range_descending"])
def test_bounds_by_key_see_the_whole_table(spark, duck, name):
    """A late row that the fixed bounds leave out is in the result."""
    got = catalog.queries()[f"{name}_by_user"](spark, SF).toPandas()
    assert got["event_id"].max() > 900
