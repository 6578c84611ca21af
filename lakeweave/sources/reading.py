"""Reading a source under its contract: its physical schema is compared first, then its rows are read with the declared one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.contracts import LINEAGE, Contract, ContractError
from lakeweave.sources.storage import Store


def physical_schema(spark: SparkSession, contract: Contract, path: str) -> T.StructType:
    """What the source itself says: a Parquet footer's fields, or a CSV header's names (as strings)."""
    if contract.format == "parquet":
        return spark.read.parquet(path).schema
    return spark.read.option("header", True).option("inferSchema", False).csv(path).schema


def schema_differences(contract: Contract, found: T.StructType) -> list[str]:
    """In words, how a physical schema differs from the contract: names, order, and for typed formats types."""
    want = contract.source_schema()
    out = []
    names, have = want.fieldNames(), found.fieldNames()
    out += [f"column {n!r} is missing" for n in names if n not in have]
    out += [f"column {n!r} is not declared" for n in have if n not in names]
    if not out and names != have:
        out.append(f"columns are in another order: {have}")
    if contract.format != "csv":
        for f in want:
            if f.name in have and not _same(f.dataType, found[f.name].dataType):
                out.append(f"column {f.name!r} is {found[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return out


def _same(a: T.DataType, b: T.DataType) -> bool:
    # both timestamp types are stored alike; the declared one decides how it is read
    times = (T.TimestampType, T.TimestampNTZType)
    return a == b or isinstance(a, times) and isinstance(b, times)


def read_source(spark: SparkSession, contract: Contract, path: str | None = None) -> DataFrame:
    """The source's rows in its own columns, behind the contract's `where`. Bad headers and types are refused here, bad
    values when rows are read."""
    path = path or contract.path
    if not Store(spark).exists(path):
        raise FileNotFoundError(path)
    found = physical_schema(spark, contract, path)
    if differences := schema_differences(contract, found):
        raise ContractError(f"{contract.key}: {'; '.join(differences)}")
    schema = contract.source_schema()
    if contract.format == "parquet":
        rows = spark.read.parquet(path).select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if found[f.name].dataType != f.dataType else F.col(f"`{f.name}`") for f in schema])
    else:
        rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return rows.where(contract.text(contract.where)) if contract.where else rows


def with_lineage(rows: DataFrame, *, source_file: str, source_sha256: str, ingested_at: datetime, run_id: str, schema_version: str) -> DataFrame:
    """rows and the lineage columns, as literals."""
    values = dict(_source_file=source_file, _source_sha256=source_sha256, _ingested_at=ingested_at, _run_id=run_id, _schema_version=schema_version)
    return rows.withColumns({f.name: F.lit(values[f.name]).cast(f.dataType) for f in LINEAGE})


def from_rows(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows that are at hand, also none, under an explicit schema."""
    return spark.createDataFrame(rows, schema)
