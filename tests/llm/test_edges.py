"""The llm pN queries over empty and odd tables."""

import pytest

from censo.llm import catalog
from tests.edges import empty_tables, odd_tables

NAMES = sorted(n for n in catalog.queries() if n[0] == "p" and n[1].isdigit())


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return empty_tables(tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return odd_tables(tmp_path_factory.mktemp("odd"))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert catalog.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables_do_not_fail(spark, odd, name):
    catalog.queries()[name](spark, odd).collect()
