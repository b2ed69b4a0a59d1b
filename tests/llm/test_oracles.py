import pytest

from plumbline.llm import queries
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    compare(df, queries.oracle_sql()[name], SF)
