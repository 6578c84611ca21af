"""The registered queries over the driver's tables, each beside the SQL that gives the same rows.

Each query goes through the
library's operators; what the operators mean is said once more, independently, by its SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.contracts import Contract, Field, Grain, Rule
from lakeweave.functions import derive as d
from lakeweave.operators import asof, dedup, profiling, quality
from lakeweave.operators.enrich import Lookup, enrich, misses, unmatched_keys
from lakeweave.operators.grain import lower_median, reduce_to
from lakeweave.operators.shaping import shape
from lakeweave.plans import ingest, layouts
from lakeweave.plans.registered import QUERIES, query, read
from lakeweave.sources.reading import from_rows, read_source, with_lineage
from lakeweave.sources.scratch import scratch_lake
from lakeweave.streaming import arrivals

# -- contracts over the driver's tables ----------------------------------------------------------

LINEITEM = tuple(
    Field(n, k, n.removeprefix("l_"))
    for n, k in {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
        "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    }.items()
)
ORDER = tuple(
    Field(n, k)
    for n, k in {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}.items()
)
EVENT = tuple(Field(n, k) for n, k in {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}.items())
CUSTOMER = tuple(Field(n, k) for n, k in {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}.items())
NATION = (Field("n_nationkey", "int", "nation_id"), Field("n_name", "string", "nation"), Field("n_regionkey", "int", "region_id"))


def order_contract(path: str = "", **more) -> Contract:
    return Contract(
        key="orders",
        logical_name="orders",
        format="parquet",
        path=path,
        fields=ORDER,
        derive=(("order_month", "date_format(o_orderdate, 'yyyy-MM')"),),
        rules=(
            Rule("finished_order", "o_orderstatus = 'F'"),
            Rule("cheap", "o_totalprice < 20000"),
            Rule("dear", "o_totalprice > 150000", "warn"),
            Rule("urgent", "o_orderpriority = '1-URGENT'", "warn"),
        ),
        unique=("o_orderkey",),
        **more,
    )


def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their order's date."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left").drop("o_orderkey")


LINE_RULES = Contract(
    key="dated_lines",
    logical_name="dated_lines",
    format="parquet",
    fields=(*(Field(f.source, f.type) for f in LINEITEM), Field("o_orderdate", "timestamp_ntz")),
    derive=(("minutes_to_ship", "cast((unix_timestamp(l_shipdate) - unix_timestamp(o_orderdate)) / 60.0D as double)"),),
    rules=(
        Rule("missing_date", "l_shipdate is null or o_orderdate is null"),
        Rule("shipped_before_order", "l_shipdate <= o_orderdate"),
        Rule("large_quantity", "l_quantity > 45", "warn"),
        Rule("high_discount", "l_discount > 0.08", "warn"),
    ),
)


# -- dimension joins and aggregates --------------------------------------------------------------

_ORDERS_BY_REGION = "FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def _orders_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # a nation's region is looked up among the nations before any order meets it; the planner broadcasts both by their files' size
    region = read(spark, sf_dir, "region")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")


@query(f"SELECT r_name, count(*) AS orders {_ORDERS_BY_REGION}")
def q_count_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_with_region(spark, sf_dir).groupBy("r_name").agg(F.count(F.lit(1)).alias("orders")).orderBy("r_name")


@query(f"SELECT r_name, count(*) AS orders, round(avg(o_totalprice), 6) AS avg_price {_ORDERS_BY_REGION}")
def q_avg_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their average price by region of the customer."""
    return _orders_with_region(spark, sf_dir).groupBy("r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 6).alias("avg_price")).orderBy("r_name")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_day, round(avg(o_totalprice), 6) AS avg_price FROM orders GROUP BY 1")
def q_avg_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(d.day_bucket("o_orderdate").cast("string").alias("order_day")).agg(F.round(F.avg("o_totalprice"), 6).alias("avg_price")).orderBy("order_day")


@query("""
    SELECT c.n_name AS customer_nation, s.n_name AS supplier_nation, count(*) AS lines, round(sum(l_quantity), 6) AS quantity
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation c ON c_nationkey = c.n_nationkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2""")
def q_role_playing_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dimension in two roles."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    fact = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    nation = read(spark, sf_dir, "nation")
    looks = [Lookup(role, nation, key, "n_nationkey", {"n_name": "nation"}, f"{role}_") for role, key in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return enrich(fact, looks).groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


# -- rules ---------------------------------------------------------------------------------------

_DATED = "FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
_BAD = "(l_shipdate IS NULL OR o_orderdate IS NULL OR l_shipdate <= o_orderdate)"


@query(f"""
    SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT {_BAD}) AS rows_accepted, count(*) FILTER (WHERE {_BAD}) AS rows_quarantined,
           count(*) FILTER (WHERE NOT {_BAD} AND (l_quantity > 45 OR l_discount > 0.08)) AS rows_warned {_DATED}""")
def q_quality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = quality.tag(shape(dated_lines(spark, sf_dir), LINE_RULES), LINE_RULES)
    good = F.size(quality.REJECTS) == 0
    return tagged.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(good).alias("rows_accepted"), F.count_if(~good).alias("rows_quarantined"), F.count_if(good & (F.size(quality.WARNINGS) > 0)).alias("rows_warned"))


@query(f"""
    SELECT 'reject' AS severity, 'shipped_before_order' AS rule, count(*) AS rows {_DATED} WHERE l_shipdate <= o_orderdate
    UNION ALL SELECT 'warn', 'large_quantity', count(*) {_DATED} WHERE l_quantity > 45
    UNION ALL SELECT 'warn', 'high_discount', count(*) {_DATED} WHERE l_discount > 0.08""")
def q_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_counts(quality.tag(shape(dated_lines(spark, sf_dir), LINE_RULES), LINE_RULES))


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate, date_diff('second', o_orderdate, l_shipdate) / 60.0 AS minutes_to_ship,
           CASE WHEN l_shipdate IS NULL OR o_orderdate IS NULL THEN 'missing_date' ELSE 'shipped_before_order' END AS reason {_DATED} WHERE {_BAD}""")
def q_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = quality.quarantined(quality.tag(shape(dated_lines(spark, sf_dir), LINE_RULES), LINE_RULES))
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_orderdate", "minutes_to_ship", F.array_join("quarantine_reason", ",").alias("reason"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, date_diff('second', o_orderdate, l_shipdate) / 60.0 AS minutes_to_ship {_DATED} WHERE NOT {_BAD}")
def q_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = quality.accepted(quality.tag(shape(dated_lines(spark, sf_dir), LINE_RULES), LINE_RULES))
    return good.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "minutes_to_ship")


@query("""
    SELECT c_custkey, c_acctbal < 0 AS negative_balance,
           nullif(concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_acctbal > 9000 THEN 'high_balance' END,
                            CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'segment' END), '') AS quality_flags FROM customer""")
def q_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = d.flags([("negative_balance", d.below("c_acctbal", 0)), ("high_balance", d.above("c_acctbal", 9000)), ("segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))])
    return read(spark, sf_dir, "customer").select("c_custkey", d.below("c_acctbal", 0).alias("negative_balance"), d.flag_text(names).alias("quality_flags"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""")
def q_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of rows whose composite key is repeated."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.withColumn("again", quality.repeated_key("l_orderkey", "l_linenumber")).where("again").drop("again")


@query("""
    SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows,
           count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys FROM lineitem""")
def q_key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.key_profile(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND value >= 10")
def q_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract("domain", "domain", "parquet", EVENT, f"{sf_dir}/events.parquet", where="event_type = 'purchase' and user_id in (1, 2, 3, 5, 8, 13, 21, 34) and value >= 10")
    return read_source(spark, contract).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, sha256(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag, l_linestatus)) AS fingerprint FROM lineitem")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fingerprint = d.plain_fingerprint("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fingerprint.alias("fingerprint"))


@query("""
    SELECT c_custkey, sha256('{"c0":' || c_custkey || ',"c1":"' || c_name || '","c2":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}') AS fingerprint
    FROM customer""")
def q_null_safe_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return read(spark, sf_dir, "customer").select("c_custkey", d.row_fingerprint("c_custkey", "c_name", segment).alias("fingerprint"))


@query("""
    SELECT n, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS n FROM lineitem) WHERE n > 1""")
def q_dedup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies that a deduplication takes out, with their rank."""
    lines = read(spark, sf_dir, "lineitem").withColumn("fp", d.row_fingerprint("l_orderkey", "l_linenumber"))
    marked = dedup.mark_duplicates(lines, "fp", ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"))
    return marked.where("duplicate_rank > 1").select(F.col("duplicate_rank").alias("n"), "l_orderkey", "l_partkey")


# -- time ----------------------------------------------------------------------------------------

HOURLY = Grain(
    ("hour",),
    (("value_median", lower_median("value")), ("value_mean", "round(avg(value), 6)"), ("value_min", "min(value)"), ("value_max", "max(value)"), ("observations", "count(*)"), ("users", "count(distinct user_id)")),
)


def hourly(events: DataFrame) -> DataFrame:
    return reduce_to(events.withColumn("hour", d.hour_bucket("ts").cast("timestamp_ntz")), HOURLY)


_HOURLY = """
    SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, quantile_disc(value, 0.5) AS value_median, round(avg(value), 6) AS value_mean, min(value) AS value_min, max(value) AS value_max,
           count(*) AS observations, count(DISTINCT user_id) AS users FROM events"""


@query(f"{_HOURLY} GROUP BY 1")
def q_hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(read(spark, sf_dir, "events"))


def _context(spark: SparkSession, sf_dir: str, hour) -> DataFrame:
    events = read(spark, sf_dir, "events")
    # written once: a lookup is read twice, to prove its key and to join
    table = scratch_lake(spark).table("purchases")
    table.overwrite(hourly(events.where("event_type = 'purchase'")))
    context = table.read()
    look = Lookup("purchases", context, "event_hour", "hour", {"value_mean": "mean", "observations": "observations"}, "purchase_", keep_key="purchase_hour")
    fact = events.withColumn("event_hour", hour.cast("timestamp_ntz"))
    out = enrich(fact, [look])
    return out.select("event_id", "event_hour", "purchase_mean", "purchase_observations", F.timestamp_diff("MINUTE", F.col("purchase_hour"), F.col("ts")).alias("minutes_after"), "purchases_match_status")


def _context_sql(hour: str) -> str:
    return f"""
    WITH context AS ({_HOURLY} WHERE event_type = 'purchase' GROUP BY 1)
    SELECT event_id, event_hour, value_mean AS purchase_mean, observations AS purchase_observations, CAST(trunc(date_diff('microsecond', context.hour, ts) / 60000000.0) AS BIGINT) AS minutes_after,
           CASE WHEN context.hour IS NULL THEN 'missing' ELSE 'matched' END AS purchases_match_status
    FROM (SELECT *, {hour} AS event_hour FROM events) e LEFT JOIN context ON event_hour = context.hour"""


_UTC_HOUR = "date_trunc('hour', timezone('UTC', timezone('America/New_York', ts)))::TIMESTAMP"


@query(_context_sql("date_trunc('hour', ts)::TIMESTAMP"))
def q_hour_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, d.hour_bucket("ts"))


@query(_context_sql(_UTC_HOUR))
def q_utc_hour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, d.hour_bucket(d.zone_to_utc(F.col("ts"), "America/New_York")))


@query(f"SELECT purchases_match_status, count(*) AS events FROM ({_context_sql(_UTC_HOUR)}) GROUP BY 1")
def q_match_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_utc_hour_join(spark, sf_dir).groupBy("purchases_match_status").agg(F.count(F.lit(1)).alias("events"))


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS order_month, NOT (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01') AS outside_month FROM orders""")
def q_out_of_month_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", d.month_key("o_orderdate").alias("order_month"), d.outside_month("o_orderdate", "1998-01").alias("outside_month"))


@query("""
    SELECT event_id, CASE WHEN user_id % 31 = 0 OR user_id % 31 > 29 THEN NULL ELSE make_timestamp(2024, 2, user_id % 31, event_id % 24, 0, 0) END AS from_parts,
           try_strptime(CASE WHEN event_id % 7 = 0 THEN 'nope' ELSE strftime(ts, '%Y-%m-%d %H:%M') END, '%Y-%m-%d %H:%M') AS from_text FROM events""")
def q_parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times put together from parts and from text, some of which are none."""
    events = read(spark, sf_dir, "events")
    parts = d.timestamp_from_parts(F.lit(2024), F.lit(2), F.col("user_id") % 31, F.col("event_id") % 24)
    bad = F.col("event_id") % 7 == 0
    text = d.timestamp_from_text(F.when(bad, F.lit("nope")).otherwise(F.date_format("ts", "yyyy-MM-dd")), F.when(bad, F.lit("")).otherwise(F.date_format("ts", "HH:mm")))
    return events.select("event_id", parts.cast("timestamp_ntz").alias("from_parts"), text.cast("timestamp_ntz").alias("from_text"))


@query("""
    WITH context AS (SELECT ts AS at, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ts)
    SELECT e.event_id, CASE WHEN date_diff('microsecond', c.at, e.ts) <= 3600000000 THEN c.value END AS last_value,
           CASE WHEN date_diff('microsecond', c.at, e.ts) <= 3600000000 THEN CAST(date_diff('microsecond', c.at, e.ts) // 1000000 AS BIGINT) END AS lag_seconds
    FROM events e ASOF LEFT JOIN context c ON e.ts >= c.at""")
def q_asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last purchase in the hour before it."""
    events = read(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("ts", "value")
    out = asof.asof_backward(events.select("event_id", F.col("ts").alias("at")), purchases, "at", "ts", columns={"value": "last_value"})
    return out.select("event_id", "last_value", F.timestamp_diff("SECOND", F.col("ts_matched"), F.col("at")).alias("lag_seconds"))


@query("""
    WITH context AS (SELECT user_id AS u, ts AS at, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT e.event_id, CASE WHEN date_diff('microsecond', c.at, e.ts) <= 86400000000 THEN c.value END AS last_value
    FROM events e ASOF LEFT JOIN context c ON e.user_id = c.u AND e.ts >= c.at""")
def q_asof_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the same user's last purchase in the day before it."""
    events = read(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    out = asof.asof_backward(events.select("event_id", "user_id", F.col("ts").alias("at")), purchases, "at", "ts", by=("user_id",), horizon_minutes=1440, columns={"value": "last_value"})
    return out.select("event_id", "last_value")


# -- keys and profiles ---------------------------------------------------------------------------


@query("SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def q_anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders that are not among those in credit."""
    return unmatched_keys(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) FILTER (WHERE {n} IS NULL) AS nulls, min({n})::VARCHAR AS min_value, max({n})::VARCHAR AS max_value FROM {t}" for n, t in (("c_custkey", "customer"), ("c_name", "customer"), ("c_mktsegment", "customer"))
))
def q_profile_nulls_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.null_min_max(read(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT count(*) AS rows, count(DISTINCT (event_type, user_id)) AS distinct_keys, count(*) - count(DISTINCT (event_type, user_id)) AS duplicate_rows, 0::BIGINT AS null_keys FROM events")
def q_profile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.key_profile(read(spark, sf_dir, "events"), "event_type", "user_id")


@query("SELECT count(*) AS buckets, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 6) AS avg_rows FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('hour', ts))")
def q_obs_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.rows_per_bucket(read(spark, sf_dir, "events"), "date_trunc('hour', ts)")


@query("SELECT DISTINCT 'event_type' AS column_name, event_type AS value FROM events UNION ALL SELECT DISTINCT 'user_id', user_id::VARCHAR FROM events")
def q_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of two columns, one of which has many."""
    return profiling.distinct_values(read(spark, sf_dir, "events"), ["event_type", "user_id"])


# -- sources and tables --------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS nation_id, n_name AS nation, n_regionkey::BIGINT AS region_id FROM nation")
def q_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read under a contract."""
    path = f"{scratch_lake(spark).root}/nation_csv"
    read(spark, sf_dir, "nation").write.option("header", True).csv(path)
    contract = Contract("nation", "nation", "csv", tuple(Field(f.source, "bigint" if f.type == "int" else f.type, f.name) for f in NATION), path)
    return shape(read_source(spark, contract), contract)


@query("SELECT c_custkey, 'customer.parquet' AS _source_file, '1' AS _schema_version, TIMESTAMP '2024-01-01 00:00:00' AS _ingested_at FROM customer")
def q_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract("customer", "customer", "parquet", CUSTOMER, f"{sf_dir}/customer.parquet")
    raw = with_lineage(read_source(spark, contract), source_file="customer.parquet", source_sha256="0" * 64, ingested_at=datetime(2024, 1, 1), run_id="r", schema_version="1")
    return raw.select("c_custkey", "_source_file", "_schema_version", F.col("_ingested_at").cast("timestamp_ntz").alias("_ingested_at"))


_ORDER_BAD = "(o_orderstatus = 'F' OR o_totalprice < 20000)"


@query(f"""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS order_month, NOT {_ORDER_BAD} AS accepted,
           CASE WHEN {_ORDER_BAD} THEN concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'finished_order' END, CASE WHEN o_totalprice < 20000 THEN 'cheap' END) END AS reasons FROM orders""")
def q_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run of a contract, and its tables read back."""
    lake = scratch_lake(spark)
    ingest.ingest(spark, lake, order_contract(f"{sf_dir}/orders.parquet", partition_by=("order_month",)))
    good = ingest.silver(lake, "orders").select("o_orderkey", "order_month", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reasons"))
    bad = ingest.quarantine(lake, "orders").select("o_orderkey", "order_month", F.lit(False).alias("accepted"), F.array_join("quarantine_reason", ",").alias("reasons"))
    return good.unionByName(bad)


@query(f"""
    SELECT status, count(*) AS runs, max(rows_read) AS rows_read, max(rows_quarantined) AS rows_quarantined, max(rows_warned) AS rows_warned FROM (
        SELECT 'success' AS status, count(*) AS rows_read, count(*) FILTER (WHERE {_ORDER_BAD}) AS rows_quarantined,
               count(*) FILTER (WHERE NOT {_ORDER_BAD} AND (o_totalprice > 150000 OR o_orderpriority = '1-URGENT')) AS rows_warned FROM orders
        UNION ALL SELECT 'skipped', 0, 0, 0 UNION ALL SELECT 'failed', 0, 0, 0) GROUP BY 1""")
def q_append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, the same again, and one that can't be: what the ledger says."""
    lake = scratch_lake(spark)
    contract = order_contract(f"{sf_dir}/orders.parquet")
    for path in (contract.path, contract.path, f"{sf_dir}/nation.parquet"):
        try:
            ingest.ingest(spark, lake, contract, path)
        except ValueError:
            pass
    return ingest.ledger(lake).groupBy("status").agg(F.count(F.lit(1)).alias("runs"), *(F.max(k).alias(k) for k in ("rows_read", "rows_quarantined", "rows_warned")))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders FROM orders GROUP BY 1")
def q_month_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scratch_lake(spark).table("orders")
    table.overwrite(shape(read(spark, sf_dir, "orders"), order_contract()), ("order_month",))
    return table.read().groupBy("order_month").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1998-03'")
def q_pruned_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of a month-partitioned table: other folders are not read."""
    table = scratch_lake(spark).table("orders")
    table.overwrite(shape(read(spark, sf_dir, "orders"), order_contract()), ("order_month",))
    return table.read().where("order_month = '1998-03'").select("o_orderkey", "o_totalprice")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus IN ('O', 'F')
    AND NOT (o_orderstatus = 'O' AND o_totalprice <= 100000)""")
def q_replace_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices are written, one of them anew."""
    table = scratch_lake(spark).table("prices")
    orders = read(spark, sf_dir, "orders")
    for status in ("O", "F"):
        table.replace(orders.where(F.col("o_orderstatus") == status).select("o_orderkey", F.col("o_totalprice").alias("price")), status)
    table.replace(orders.where("o_orderstatus = 'O' and o_totalprice > 100000").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price")), "O")
    return table.read()


@query("SELECT n_nationkey AS id, n_name AS name, NULL::INTEGER AS region FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def q_schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append with one more column."""
    table = scratch_lake(spark).table("nations")
    nation = read(spark, sf_dir, "nation")
    table.append(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    table.append(nation.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return table.read()


@query("SELECT r_regionkey, r_name FROM region")
def q_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of a table that was overwritten, appended to, compacted and emptied since."""
    table = scratch_lake(spark).table("regions")
    region = read(spark, sf_dir, "region")
    first = table.overwrite(region.select("r_regionkey", "r_name"))
    table.append(region.select("r_regionkey", "r_name"))
    table.compact()
    table.delete("r_regionkey >= 0")
    if not table.read().isEmpty():
        raise ValueError("the table was to be empty")
    return table.read(first.version)


_LAYOUT_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders, round(avg(o_totalprice), 6) AS avg_price FROM orders GROUP BY 1"


@query(f"SELECT layout, t.* FROM ({_LAYOUT_SQL}) t, (SELECT unnest(['flat', 'by_month', 'clustered']) AS layout)")
def q_layout_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query over three layouts of a table, whose rows must agree."""
    lake = scratch_lake(spark)
    ways = [layouts.Layout("flat"), layouts.Layout("by_month", ("order_month",)), layouts.Layout("clustered", cluster_by=("order_month", "o_orderkey"))]
    by_month = lambda t: t.groupBy("order_month").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 6).alias("avg_price"))
    layouts.compare(lake, lambda: shape(read(spark, sf_dir, "orders"), order_contract()), ways, {"by_month": by_month}, repeats=1)
    out = None
    for w in ways:
        one = by_month(lake.table(w.name).read()).withColumn("layout", F.lit(w.name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, s_nationkey AS supplier_nationkey, n_name AS supplier_nation,
           CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'matched' END AS supplier_match_status, CASE WHEN n_nationkey IS NULL THEN 'missing' ELSE 'matched' END AS nation_match_status
    FROM (SELECT * {_DATED} WHERE NOT {_BAD}) LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def q_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted lines enriched by two lookups, of which the second depends on the first; misses stay with nulls."""
    fact = quality.accepted(quality.tag(shape(dated_lines(spark, sf_dir), LINE_RULES), LINE_RULES))
    supplier = read(spark, sf_dir, "supplier").where("s_acctbal > 0")
    first = enrich(fact, [Lookup("supplier", supplier, "l_suppkey", "s_suppkey", {"s_nationkey": "nationkey"}, "supplier_")])
    both = enrich(first, [Lookup("nation", read(spark, sf_dir, "nation"), "supplier_nationkey", "n_nationkey", {"n_name": "nation"}, "supplier_")])
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "supplier_nationkey", "supplier_nation", "supplier_match_status", "nation_match_status")


@query("SELECT 'orders' AS dataset_key, count(*) AS rows_read, count(*) FILTER (WHERE o_orderstatus = 'F' OR o_totalprice < 20000) AS rows_quarantined FROM orders")
def q_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest successful run of each source, of two that were forced."""
    lake = scratch_lake(spark)
    for _ in range(2):
        ingest.ingest(spark, lake, order_contract(f"{sf_dir}/orders.parquet"), force=True)
    return ingest.latest_runs(lake).select("dataset_key", "rows_read", "rows_quarantined")


@query(f"SELECT o_orderkey, NOT {_ORDER_BAD} AS accepted FROM orders")
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row-local rules over files as they arrive."""
    lake = scratch_lake(spark)
    contract = replace(order_contract(), unique=())
    landing = f"{lake.root}/landing"
    read(spark, sf_dir, "orders").write.parquet(landing)
    arrivals.land(spark, lake, contract, landing, f"{lake.root}/stream").awaitTermination()
    good = ingest.silver(lake, "orders").select("o_orderkey", F.lit(True).alias("accepted"))
    return good.unionByName(ingest.quarantine(lake, "orders").select("o_orderkey", F.lit(False).alias("accepted")))


@query("""
    SELECT s_suppkey, n_name AS supplier_nation, n_nationkey IS NULL AS quarantined FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON s_nationkey = n_nationkey""")
def q_missing_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a match of a lookup that must match are set aside."""
    nation = read(spark, sf_dir, "nation").where("n_regionkey <> 1")
    looks = [Lookup("nation", nation, "s_nationkey", "n_nationkey", {"n_name": "nation"}, "supplier_", on_miss="quarantine")]
    return enrich(read(spark, sf_dir, "supplier"), looks).select("s_suppkey", "supplier_nation", misses(looks, "quarantine").alias("quarantined"))


@query("""
    SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FILTER (WHERE o_totalprice > 100000) FROM orders) AS counted,
           (SELECT count(DISTINCT o_orderstatus) FROM orders) AS statuses""")
def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of all columns in one pass, with a counted predicate."""
    rows = read(spark, sf_dir, "orders")
    found = profiling.profile_columns(rows, {"dear": "o_totalprice > 100000"})
    values = profiling.distinct_values(rows, ["o_orderstatus"])
    return from_rows(spark, [("orders", found["rows"], found["counts"]["dear"], values.count())], "table_name string, rows long, counted long, statuses long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lakeweave.plans import catalog_runs  # noqa: F401 registers more

    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {n: sql for n, (_, sql) in QUERIES.items()}
