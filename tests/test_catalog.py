import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from lakeweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return round(float(value), 9)
    if isinstance(value, (date, datetime)):
        return str(value)
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        yield con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    want = duck.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    order = [want.columns.index(c) for c in columns]
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_pruned_month_is_scanned(spark, sf_dir):
    from lakeweave.plans.layouts import plan_text

    plan = plan_text(catalog.queries()["q_pruned_month"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(order_month" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_small_dimensions_are_broadcast_and_columns_pruned(spark, sf_dir):
    from lakeweave.plans.layouts import plan_text

    plan = plan_text(catalog.queries()["q_role_playing_dims"](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan


def test_codecs_of_a_source_whose_first_split_has_no_rows(spark, sf_dir):
    """The first task writes a file without a row group then."""
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, "4096")
    try:
        assert catalog.read(spark, sf_dir, "orders").rdd.glom().map(len).first() == 0
        got = catalog.queries()["q_compression"](spark, sf_dir).collect()
    finally:
        spark.conf.unset(name)
    assert sorted(map(tuple, got)) == [("GZIP", 1500, True), ("SNAPPY", 1500, True), ("ZSTD", 1500, True)]
