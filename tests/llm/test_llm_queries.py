import pytest

from chainweft.llm import queries
from oracle import difference


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equals_sql_or_runs(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLES:
        assert difference(df, queries.ORACLES[name], sf_dir) is None
    else:
        df.count()
