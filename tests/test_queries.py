"""Every registered query of the library's own operators against its DuckDB twin."""

import pytest

from docwatch.plans import catalog
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, sf, con, name):
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
