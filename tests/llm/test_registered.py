"""Registered queries: SQL where there is some, else they run and keep their columns."""

import pytest

from quillmill.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
