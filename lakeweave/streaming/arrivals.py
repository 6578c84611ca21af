"""Arriving files under a contract, by Structured Streaming.

Shaping and row rules are the batch operators; unique keys are not, as they need all rows, so contracts
with keys are refused here. Each micro-batch commits under its own number: one that runs again after a
failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.contracts import Contract, ContractError
from lakeweave.operators import quality
from lakeweave.operators.shaping import shape
from lakeweave.sources.snapshots import Lake, Segment


def arriving(spark: SparkSession, contract: Contract, folder: str) -> DataFrame:
    """The shaped and tagged rows of files as they arrive."""
    if contract.unique:
        raise ContractError(f"{contract.key}: unique keys can't be checked on a stream")
    reader = spark.readStream.schema(contract.source_schema())
    if contract.format == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    raw = reader.format(contract.format).load(folder)
    raw = raw.where(contract.text(contract.where)) if contract.where else raw
    return quality.tag(shape(raw, contract), contract)


def land(spark: SparkSession, lake: Lake, contract: Contract, folder: str, checkpoint: str):
    """A query that appends accepted and refused rows to the lake's tables, as far as files are there."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()
        changes = []
        for name, rows, keys in (("silver", quality.accepted(batch), contract.partition_by), ("quarantine", quality.quarantined(batch), ())):
            staged = lake.stage(rows, keys)
            segment = Segment(staged.path, staged.path, f"batch-{number}")
            changes.append(lake.table(f"{name}_{contract.logical_name}").adopting([segment], staged.schema, keys, mode="replace"))
        lake.commit(changes)
        batch.unpersist()

    return arriving(spark, contract, folder).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(rows: DataFrame, ts: str, measures: dict[str, str], late: str = "2 hours") -> DataFrame:
    """One row for each hour, final once the watermark has passed it."""
    times = rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return times.groupBy(F.window("_ts", "1 hour").alias("_w")).agg(*(F.expr(e).alias(n) for n, e in measures.items())).select(F.col("_w.start").alias("hour"), *measures)
