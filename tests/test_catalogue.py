import pytest

from amberlog.plans import catalogue, coverage, problems  # noqa: F401
from tests.oracle import differences

SQL = catalogue.oracle_sql() | problems.oracle_sql()
QUERIES = catalogue.queries() | problems.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], SQL[name]) == ""


def test_every_catalogue_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_whole_tables_are_taken(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    assert QUERIES["merge_two_runs"](spark, sf).count() == t("customer").count() + t("supplier").count()
    assert QUERIES["two_hop"](spark, sf).count() == t("lineitem").count()
    errors = {r.user_id for r in t("events").where("event_type = 'error'").collect()}
    assert not errors & {r.user_id for r in QUERIES["delete_wins"](spark, sf).collect()}
