import pytest

from oremill import queries_graph, queries_knowledge  # noqa: F401  register their queries
from oremill.queries import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    got, want = spark_rows(QUERIES[name](spark, SF)), duck_rows(SF, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
