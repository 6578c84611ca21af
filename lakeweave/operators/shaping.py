"""From source columns to shaped columns: one projection, compiled from the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.contracts import LINEAGE, Contract


def shape(raw: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns under their own names, the lineage columns that are there, and what it derives, in order.

    Derivations may use all columns before them, so each is a step of its own; Catalyst makes one projection of them.
    """
    lineage = [n for n in LINEAGE.fieldNames() if n in raw.columns]
    out = raw.select(*(F.col(f"`{f.source}`").alias(f.target) for f in contract.fields), *lineage)
    for name, expression in contract.derive:
        out = out.withColumn(name, F.expr(contract.text(expression)))
    return out
