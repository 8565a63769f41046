"""The driver contract."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_a_stable_schema(spark):
    first, again = entry.entry(spark), entry.entry(spark)
    assert first.schema == again.schema and first.columns


def test_reference_queries_do_not_need_the_training_data_operators():
    from plinth.plans import catalog

    assert not any("llm" in query.__module__ for query in catalog.QUERIES.values())
