"""Deduplication by fingerprint with retained rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_duplicates(rows: DataFrame, fingerprint: str, order_by: tuple[str, ...]) -> DataFrame:
    """The rows with `duplicate_rank`, 1 for the copy that stays. The order must be total for the choice to be stable."""
    return rows.withColumn("duplicate_rank", F.row_number().over(Window.partitionBy(fingerprint).orderBy(*order_by)).cast("long"))


def split_duplicates(rows: DataFrame, fingerprint: str, order_by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    marked = mark_duplicates(rows, fingerprint, order_by)
    return marked.where("duplicate_rank = 1").drop("duplicate_rank"), marked.where("duplicate_rank > 1").drop("duplicate_rank")


def duplicate_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
