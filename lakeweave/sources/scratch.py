"""A folder for tables that a query writes on its way, where driver and executors both reach it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from lakeweave.sources.snapshots import Lake


def scratch_lake(spark: SparkSession) -> Lake:
    """A new lake below spark.checkpoint.dir; in local mode, if that is unset, below this machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return Lake(spark, f"{root.rstrip('/')}/lakeweave-lake-{uuid.uuid4().hex}")
