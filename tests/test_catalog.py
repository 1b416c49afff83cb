"""Every registered query against its SQL, over whole tables."""

import pytest

from plumbline.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    at = "/root/testdata/sf0.01"
    if name in catalog.ORACLE_SQL:
        compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], at)
    else:
        assert catalog.QUERIES[name](spark, at).count() >= 0
