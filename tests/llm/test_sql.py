import pytest

from amberlog.llm import problems
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(problems.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, problems.queries()[name], problems.oracle_sql()[name]) == ""
