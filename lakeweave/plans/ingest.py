"""Running a contract: raw rows, accepted rows and refused rows into a lake, and a ledger of every run.

A run reads its source once: raw rows with lineage go to `bronze/<key>`, and everything after that
reads those. Tags, counts and the split come from one more pass that writes accepted and refused rows
side by side; their folders then become live, each instead of what the same source wrote before, in one
commit of all tables and the ledger. (The fingerprint that tells whether the source has been taken in before
is made by a pass of its own.)
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.contracts import Contract, ContractError, Registry
from lakeweave.operators import quality
from lakeweave.operators.grain import reduce_to
from lakeweave.operators.shaping import shape
from lakeweave.sources.reading import read_source, with_lineage
from lakeweave.sources.snapshots import Change, Lake, Segment
from lakeweave.sources.storage import Store

LEDGER = "ledger_runs"

#: The ledger is compacted when more runs than these have a folder of their own.
LEDGER_FOLDERS = 100

RUN = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("run_id", "dataset_key", "dataset_name", "source_file", "source_sha256", "schema_version")]
    + [T.StructField(n, T.LongType(), False) for n in ("rows_read", "rows_accepted", "rows_quarantined", "rows_warned")]
    + [T.StructField("started_at", T.TimestampType(), False), T.StructField("finished_at", T.TimestampType(), False)]
    + [T.StructField("status", T.StringType(), False), T.StructField("error_message", T.StringType(), True)]
)
_COUNTS = ("rows_read", "rows_accepted", "rows_quarantined", "rows_warned")


def ledger(lake: Lake) -> DataFrame:
    """All runs: success, failed and skipped."""
    table = lake.table(LEDGER)
    table.create(RUN)
    return table.read()


def latest_runs(lake: Lake, status: str = "success") -> DataFrame:
    """The last finished run of each dataset and source."""
    whole = F.struct(*RUN.fieldNames())
    return ledger(lake).where(F.col("status") == status).groupBy("dataset_key", "source_file").agg(F.max_by(whole, F.struct("finished_at", "run_id")).alias("r")).select("r.*")


def already_done(lake: Lake, contract: Contract, digest: str) -> bool:
    """Whether these bytes have been taken in under this version of the contract."""
    found = ledger(lake).where(
        (F.col("dataset_key") == contract.key) & (F.col("source_sha256") == digest) & (F.col("schema_version") == contract.version) & (F.col("status") == "success")
    )
    return not found.isEmpty()


def _table(layer: str, name: str) -> str:
    return f"{layer}_{name}"


def bronze(lake: Lake, key: str) -> DataFrame:
    return lake.table(_table("bronze", key)).read()


def silver(lake: Lake, name: str) -> DataFrame:
    return lake.table(_table("silver", name)).read()


def quarantine(lake: Lake, name: str) -> DataFrame:
    return lake.table(_table("quarantine", name)).read()


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def ingest(spark: SparkSession, lake: Lake, contract: Contract, path: str | None = None, *, force: bool = False) -> dict:
    """Take a source in; the ledger's row of the run. A source that was taken in before is skipped unless forced; a run
    that fails is told in the ledger, leaves all tables as they were, and raises."""
    path = path or contract.path
    run = {"run_id": uuid.uuid4().hex, "dataset_key": contract.key, "dataset_name": contract.logical_name, "source_file": path.rstrip("/").rsplit("/", 1)[-1]}
    run |= {"source_sha256": "", "schema_version": contract.version, "started_at": _now()} | dict.fromkeys(_COUNTS, 0)

    def record(status: str, error: str | None = None, changes: tuple[Change, ...] = ()) -> dict:
        """The run's row goes live with all that the run has written."""
        row = run | {"finished_at": _now(), "status": status, "error_message": error}
        told = lake.stage(spark.createDataFrame([tuple(row[n] for n in RUN.fieldNames())], RUN).coalesce(1))
        table = lake.table(LEDGER)
        *_, m = lake.commit([*changes, table.adopting([Segment(told.path, told.path)], RUN)])
        if len(m.segments) > LEDGER_FOLDERS:
            table.compact()
        return row

    try:
        run["source_sha256"] = Store(spark).sha256(path)
        if not force and already_done(lake, contract, run["source_sha256"]):
            return record("skipped")
        metrics, changes = _take_in(spark, lake, contract, path, run)
        run |= metrics
        return record("success", changes=changes)
    except Exception as e:
        record("failed", f"{type(e).__name__}: {e}"[:2000])
        raise


def _take_in(spark: SparkSession, lake: Lake, contract: Contract, path: str, run: dict) -> tuple[dict[str, int], tuple[Change, ...]]:
    """What the run counted, and the changes of its tables; their data is written but not live."""
    raw = with_lineage(
        read_source(spark, contract, path), source_file=run["source_file"], source_sha256=run["source_sha256"], ingested_at=run["started_at"], run_id=run["run_id"], schema_version=contract.version
    )
    first = lake.stage(raw)
    landed = spark.read.schema(first.schema).parquet(f"{lake.root}/{first.path}")

    seen = Observation()
    tagged = quality.counts(quality.tag(shape(landed, contract), contract), seen)
    both = tagged.withColumn("_accepted", F.size(quality.REJECTS) == 0)
    split = lake.stage(both, ("_accepted", *contract.partition_by))
    metrics = {k: seen.get[k] for k in _COUNTS}
    quality.reconcile(metrics, contract)

    shaped = T.StructType([f for f in tagged.schema if f.name not in (quality.REJECTS, quality.WARNINGS)])
    good = f"{split.path}/_accepted=true"
    if contract.grain:
        rows = spark.read.schema(shaped).option("basePath", f"{lake.root}/{good}").parquet(f"{lake.root}/{good}") if metrics["rows_accepted"] else spark.createDataFrame([], shaped)
        reduced = lake.stage(reduce_to(rows, contract.grain, contract))
        n = spark.read.schema(reduced.schema).parquet(f"{lake.root}/{reduced.path}").count()
        if contract.grain.expected_rows is not None and n != contract.grain.expected_rows:
            raise ContractError(f"{contract.key}: {n} rows were made, {contract.grain.expected_rows} are expected")
        kept, kept_schema, partition_by = [Segment(reduced.path, reduced.path, contract.key)], reduced.schema, ()
    else:
        kept, kept_schema, partition_by = [Segment(good, split.path, contract.key)] if metrics["rows_accepted"] else [], shaped, contract.partition_by

    reasons = T.StructType([*shaped, T.StructField("quarantine_reason", T.ArrayType(T.StringType()))])
    bad = f"{split.path}/_accepted=false"
    refused = []
    if metrics["rows_quarantined"]:
        rows = spark.read.schema(T.StructType([*shaped, T.StructField(quality.REJECTS, T.ArrayType(T.StringType()))])).option("basePath", f"{lake.root}/{bad}").parquet(f"{lake.root}/{bad}")
        out = lake.stage(rows.withColumnRenamed(quality.REJECTS, "quarantine_reason").select(*reasons.fieldNames()))
        refused = [Segment(out.path, out.path, contract.key)]
    return metrics, (
        lake.table(_table("bronze", contract.key)).adopting([Segment(first.path, first.path)], first.schema, mode="overwrite"),
        # also without rows: what this source's last run accepted or refused must go
        lake.table(_table("silver", contract.logical_name)).adopting(kept, kept_schema, partition_by, mode="replace", slices=(contract.key,)),
        lake.table(_table("quarantine", contract.logical_name)).adopting(refused, reasons, mode="replace", slices=(contract.key,)),
    )


def ingest_all(spark: SparkSession, lake: Lake, registry: Registry, name: str = "all", *, force: bool = False) -> list[dict]:
    return [ingest(spark, lake, c, force=force) for c in registry.select(name)]


def audit(lake: Lake, contract: Contract) -> dict:
    """What the tables hold now against what the last run says: counts, and whether keys are unique."""
    rows = silver(lake, contract.logical_name)
    last = latest_runs(lake).where(F.col("dataset_key") == contract.key).first()
    out = {"bronze_rows": bronze(lake, contract.key).count(), "silver_rows": rows.count(), "quarantine_rows": quarantine(lake, contract.logical_name).count()}
    out["last_run"] = {k: last[k] for k in _COUNTS} if last else None
    keys = contract.grain.keys if contract.grain else contract.unique
    out["unique_keys"] = rows.select(*keys).distinct().count() == out["silver_rows"] if keys else None
    return out

