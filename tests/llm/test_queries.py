from lakewarden.llm import queries

from ..oracle import compare, connect


def test_against_sql(spark, small):
    db = connect(small)
    for name, sql in queries.oracle_sql().items():
        compare(spark, small, db, queries.queries()[name], sql)


def test_all_run(spark, small):
    for name, run in queries.queries().items():
        assert run(spark, small).count() >= 0, name
