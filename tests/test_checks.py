"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as driver

SQL = driver.oracle_sql()
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def con(data_dir):
    return compare.connect(data_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, data_dir, name):
    found = driver.queries()[name](spark, data_dir)
    assert compare.spark_table(found) == compare.sql_table(con, SQL[name])
    types = {c: SAME_TYPE[t] for c, t in compare.spark_types(found).items()}
    assert types == compare.sql_types(con, SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(driver.queries())


def test_entry_has_rows(spark):
    found = driver.entry(spark)
    assert found.columns == ["segment", "reviews"]
    assert found.count() > 0


@pytest.mark.parametrize("name", ["dedup_first_seen", "representative_quotes", "merge_themes"])
def test_result_does_not_depend_on_partitions(spark, data_dir, name):
    query = driver.queries()[name]
    many = compare.spark_table(query(spark, data_dir))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert compare.spark_table(query(spark, data_dir)) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
