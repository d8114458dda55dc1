"""Every query of the core equals its SQL twin; a query without one runs and has columns."""

import pytest

from chainweft.plans import catalog
from oracle import difference


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_equals_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert difference(df, catalog.ORACLES[name], sf_dir) is None
    else:
        assert df.columns
        df.count()
