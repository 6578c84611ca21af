"""What the corpus operators share: shipping code, scratch tables, guarded broadcasts, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side of at most this many (narrow) rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

#: Rows of one Arrow batch, unless the session asks for another number than Spark's own default of 10,000: documents are
#: long, and every running task holds a batch on either side of the pipe to its Python worker.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Rows that a Python loop turns into objects at once.
SLICE_ROWS = 256

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, so that workers import it wherever the driver found it, and bound Arrow batches."""
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():
        target = os.path.join(tempfile.mkdtemp(prefix="lakeweave-"), f"lakeweave-{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path("lakeweave") / p.relative_to(root)))
        spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        place = place.rstrip("/")
        return f"file://{place[5:]}" if place.startswith("file:/") and not place.startswith("file://") else place
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"lakeweave-{spark.sparkContext.applicationId}")


_roots: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below this application's part of the shared folder, which goes when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/lakeweave/{spark.sparkContext.applicationId}"
    if root not in _roots:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
        _roots.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all that the operators have written on their way; what still reads it fails. For sessions that live long."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lakeweave/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read that: lineage ends there, and lost executors cost no rerun."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that materialize() wrote, when nothing will read it again."""
    path = vars(df).get("_scratch")  # not by attribute: a column may have that name
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def guarded(small: DataFrame, rows: int | None = None) -> DataFrame:
    """A hint to broadcast `small` if it has been counted and is within BROADCAST_ROWS; else the planner shuffles it."""
    n = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def wrapped(df: DataFrame, **needed: Column) -> DataFrame:
    """df's columns as one struct `_row`, beside the needed ones: no name of an operator can clash with the input's."""
    return df.select(F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("_row"), *(x.alias(n) for n, x in needed.items()))


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def clean_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
