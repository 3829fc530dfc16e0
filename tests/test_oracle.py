"""Every registered query that has SQL gives the rows that DuckDB gives."""

import oracle
import pytest

from sheafline import plans

CASES = sorted(plans.oracle_sql())


@pytest.fixture(scope="module")
def con(small):
    return oracle.connection(small)


@pytest.mark.parametrize("name", CASES)
def test_matches_sql(spark, small, con, name):
    ours = plans.queries()[name](spark, small)
    theirs = con.execute(plans.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert oracle.rows(ours.columns, ours.collect()) == oracle.rows(names, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(CASES)))
def test_runs(spark, small, name):
    assert plans.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
