"""Column and key profiles in one aggregate each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.sources.storage import Store

def profile_columns(rows: DataFrame, predicates: dict[str, str] | None = None) -> dict:
    """Row count, and for each column nulls, least, greatest and estimated distinct values; predicates are counted by name.
    One pass; an action."""
    simple = [f.name for f in rows.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(rows.columns):
        aggregates.append(F.count_if(F.col(f"`{n}`").isNull()).alias(f"nulls{i}"))
        if n in simple:
            aggregates += [F.min(f"`{n}`").alias(f"min{i}"), F.max(f"`{n}`").alias(f"max{i}"), F.approx_count_distinct(f"`{n}`").alias(f"distinct{i}")]
    aggregates += [F.count_if(F.expr(p)).alias(f"_p{i}") for i, p in enumerate((predicates or {}).values())]
    row = rows.agg(*aggregates).first()
    columns = {
        n: {"nulls": row[f"nulls{i}"]} | ({"min": row[f"min{i}"], "max": row[f"max{i}"], "distinct_estimate": row[f"distinct{i}"]} if n in simple else {}) for i, n in enumerate(rows.columns)
    }
    return {"rows": row["rows"], "columns": columns, "counts": {n: row[f"_p{i}"] for i, n in enumerate(predicates or {})}}


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as text) for every value of the columns but null, however many there are; partial sums, one shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").cast("string").alias("value")) for n in columns)))
    return rows.select(each.alias("v")).select("v.*").where("value is not null").distinct()


def null_min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: its name, nulls, least and greatest value as text. One aggregate, then a bounded reshaping."""
    one = rows.agg(
        *(F.struct(F.lit(n).alias("column_name"), F.count_if(F.col(n).isNull()).alias("nulls"), F.min(n).cast("string").alias("min_value"), F.max(n).cast("string").alias("max_value")).alias(n) for n in columns)
    )
    return one.select(F.explode(F.array(*columns)).alias("c")).select("c.*")


def key_profile(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, distinct_keys, duplicate_rows (rows less distinct keys) and null_keys, of a simple or composite key."""
    whole = F.struct(*keys)
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(whole).alias("distinct_keys"), F.count_if(some_null).alias("null_keys")).select(
        "rows", "distinct_keys", (F.col("rows") - F.col("distinct_keys")).alias("duplicate_rows"), "null_keys"
    )


def rows_per_bucket(rows: DataFrame, bucket: str) -> DataFrame:
    """buckets, and the least, greatest and mean number of rows to one."""
    sizes = rows.groupBy(F.expr(bucket).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("buckets"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.round(F.avg("n"), 6).alias("avg_rows"))


def file_profile(spark: SparkSession, path: str) -> dict:
    """Files, bytes, row groups and codecs of a Parquet source, its rows, columns and schema. Footers are read on the driver, one file at
    a time, as a profile of a source at hand needs; for a table's size alone there is `SnapshotTable.active_stats`. Empty files have no
    row group: a writer's first task leaves one for the schema if it gets no rows, as where a split ends before the row group's middle."""
    store = Store(spark)
    files = store.files(path)
    rows = spark.read.parquet(path)
    feet = [store.parquet_footer(f) for f, _ in files]
    return {
        "files": len(files),
        "empty_files": sum(n == 0 for n, _ in feet),
        "bytes": sum(n for _, n in files),
        "rows": rows.count(),
        "row_groups": sum(n for n, _ in feet),
        "codecs": sorted({x for _, codecs in feet for x in codecs}),
        "schema": json.loads(rows.schema.json()),
    }
