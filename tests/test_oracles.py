"""Every registered query against its SQL on the same tables."""

import pytest

from quillmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
