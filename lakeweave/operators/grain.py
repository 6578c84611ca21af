"""Reducing rows to one for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.contracts import Contract, Grain


def reduce_to(rows: DataFrame, grain: Grain, contract: Contract | None = None) -> DataFrame:
    """One row for each key, so that the key is unique by construction. Partial sums are made before the shuffle."""
    text = contract.text if contract else str
    return rows.groupBy(*grain.keys).agg(*(F.expr(text(e)).alias(n) for n, e in grain.measures))


def lower_median(column: str) -> str:
    """A median that is always a value of the group: of an even number the lower middle one. Exact, as a double; its state is a count
    for each distinct value of a group, in partial sums before the shuffle."""
    return f"percentile_disc(0.5) within group (order by {column})"
