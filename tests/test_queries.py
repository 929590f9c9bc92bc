import pytest

import lorewell.plans.project_queries  # noqa: F401  adds its queries
from lorewell.plans.queries import QUERIES, SQL

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, same_rows, name):
    same_rows(QUERIES[name](spark, DATA), SQL[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points_need_no_other_part(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "score"]
