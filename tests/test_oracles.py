import pytest

from plumbline.plans import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


def test_entry(spark):
    import __spark_entry__

    got = {r.hazard: (r.num_scored_items, r.num_safe_items) for r in __spark_entry__.entry(spark).collect()}
    want = [(2, 2), (6, 5), (7, 7), (6, 6), (4, 4), (2, 2), (3, 2), (2, 2), (3, 3), (10, 7), (6, 6), (3, 2)]
    assert got == dict(zip("vcr ncr src cse dfm spc prv ipv iwp hte ssh sxc".split(), want, strict=True))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
