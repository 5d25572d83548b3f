import os

import pytest

from kmerloom.plans import catalog
from tests.oracle import DATA, expect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.ORACLE_SQL:
        expect(df, catalog.ORACLE_SQL[name])
    else:
        assert df.count()


def test_entry():
    import __spark_entry__ as e

    assert catalog.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
