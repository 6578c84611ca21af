"""Backward as-of join within a horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, *, by: tuple[str, ...] = (), horizon_minutes: int = 60, columns: dict[str, str], lag_name: str = "lag_minutes") -> DataFrame:
    """Each left row with the latest right row at or before its time, at most the horizon before, and how many minutes
    before that was. Equal right times: the greatest values win. Null times and keys match nothing; no left row is lost.

    Both sides are dealt by (by, bucket), where buckets are as long as the horizon and a right row stands in its own and
    the next one, and sorted by time; a running last value then meets every left row. No group is ever held in memory,
    and keys without `by` are still dealt over all buckets.
    """
    width = horizon_minutes * 60
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))
    value = F.struct(*(F.col(s).alias(t) for s, t in columns.items()))
    keys = [f"_by{i}" for i in range(len(by))]
    known = F.col(right_ts).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    latest = right.where(known).groupBy(*by, right_ts).agg(F.max(value).alias("_v"))
    rights = latest.select(
        *(F.col(k).alias(n) for k, n in zip(by, keys)), F.explode(F.array(bucket(right_ts), bucket(right_ts) + 1)).alias("_bucket"),
        F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_ts).alias("_rt"), "_v").alias("_pair"),
    )
    lefts = left.select(
        *(F.col(k).alias(n) for k, n in zip(by, keys)), bucket(left_ts).alias("_bucket"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
        F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_row"),
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    # at equal times right rows come first
    before = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_last", F.last("_pair", ignorenulls=True).over(before)).where("_side = 1")
    lag = F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_last._rt").cast("timestamp"))
    picked = met.withColumn("_lag", lag).withColumn("_hit", F.when(F.col("_lag") <= width * 1_000_000, F.col("_last")))
    return picked.select(
        "_row.*", *(F.col(f"_hit._v.{t}").alias(t) for t in columns.values()), F.col("_hit._rt").alias(f"{right_ts}_matched"),
        F.when(F.col("_hit").isNotNull(), F.col("_lag") / F.lit(60_000_000.0)).alias(lag_name),
    )
