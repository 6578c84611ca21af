"""More registered queries: the city's contracts over sources made of the driver's tables, gates, tables under change, reports."""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
import zipfile
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeweave.contracts import Contract, ContractError, Field, Registry
from lakeweave.functions import derive as d
from lakeweave.operators import profiling, quality
from lakeweave.operators.enrich import Lookup, enrich, observe, verify
from lakeweave.operators.shaping import shape
from lakeweave.plans import city, ingest, layouts
from lakeweave.plans.catalog import order_contract
from lakeweave.plans.registered import query, read
from lakeweave.sources.reading import from_rows
from lakeweave.sources.scratch import scratch_lake
from lakeweave.sources.snapshots import Lake

# -- the city's sources, made of the driver's tables -----------------------------------------------


def _file(df: DataFrame, path: str, fields: tuple[Field, ...]) -> str:
    """A CSV source with all columns of the published file; those that df lacks are empty."""
    df.select(*((F.col(f"`{f.source}`") if f.source in df.columns else F.lit(None).cast("string").alias(f.source)) for f in fields)).write.option("header", True).csv(path)
    return path


def _weather(spark: SparkSession, sf_dir: str, path: str) -> Contract:
    """An hour of events is an hour of weather. Of hours whose events a 7 divides the day is the 32nd; those that a 5 divides come twice."""
    hours = read(spark, sf_dir, "events").groupBy(d.hour_bucket("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("temp"))
    twice = F.explode(F.when((F.col("n") % 5 == 0) & (F.col("n") % 7 != 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = hours.select(F.year("h").alias("year"), F.month("h").alias("month"), F.when(F.col("n") % 7 == 0, 32).otherwise(F.dayofmonth("h")).alias("day"), F.hour("h").alias("hour"), "temp", F.col("n").alias("rhum"), twice.alias("_"))
    return city.weather(_file(rows, path, city.WEATHER_FIELDS))


_WEATHER = "SELECT date_trunc('hour', ts)::TIMESTAMP AS h, count(*) AS n, min(value) AS temp FROM events GROUP BY 1"


@query(f"""
    SELECT CASE WHEN n % 7 <> 0 THEN strftime(h, '%Y-%m-%d %H:%M') END AS observed, temp, n AS rhum, 'local_wall_clock_unconfirmed_timezone' AS semantics,
           CASE WHEN n % 7 = 0 THEN 'missing_observation_ts_local' WHEN n % 5 = 0 THEN 'duplicate_observation_ts_local' END AS reason
    FROM ({_WEATHER}), (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR (n % 5 = 0 AND n % 7 <> 0)""")
def q_weather_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather: calendar parts that are no date, and hours told twice, are refused."""
    lake = scratch_lake(spark)
    ingest.ingest(spark, lake, _weather(spark, sf_dir, f"{lake.root}/weather"))
    out = lambda rows, why: rows.select(F.date_format("observation_ts_local", "yyyy-MM-dd HH:mm").alias("observed"), "temp", "rhum", F.col("timestamp_semantics").alias("semantics"), why.alias("reason"))
    return out(ingest.silver(lake, "weather_hourly"), F.lit(None).cast("string")).unionByName(out(ingest.quarantine(lake, "weather_hourly"), F.array_join("quarantine_reason", ",")))


_COUNTY = ("Bronx", "Kings", "New York", "Queens", "Richmond", "Albany")


def _air(spark: SparkSession, sf_dir: str, path: str) -> Contract:
    """An event is a measurement."""
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        F.when(e % 13 == 0, "34").otherwise("36").alias("State Code"),
        F.lpad((F.col("user_id") % 3).cast("string"), 3, "0").alias("County Code"),
        F.lpad((F.col("user_id") % 7).cast("string"), 4, "0").alias("Site Num"),
        F.when(e % 11 == 0, "88502").otherwise("88101").alias("Parameter Code"),
        (e % 4).cast("string").alias("POC"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date GMT"),
        F.when(e % 17 == 0, "nope").otherwise(F.date_format("ts", "HH:00")).alias("Time GMT"),
        F.when(e % 19 != 0, F.round(F.col("value") - 20, 2)).alias("Sample Measurement"),
        F.element_at(F.array(*map(F.lit, _COUNTY)), (e % 6 + 1).cast("int")).alias("County Name"),
    )
    return city.air_quality(_file(rows, path, city.AIR_FIELDS))


_AIR = f"""
    SELECT h, quantile_disc(v, 0.5) AS pm25_median, round(avg(v), 6) AS pm25_mean, min(v) AS pm25_min, max(v) AS pm25_max, count(*) AS observations, count(DISTINCT site) AS sites FROM (
        SELECT *, count(*) OVER (PARTITION BY user_id % 3, user_id % 7, event_id % 4, h) AS again FROM (
            SELECT user_id, event_id, date_trunc('hour', ts)::TIMESTAMP AS h, round(value - 20, 2) AS v, {list(_COUNTY)}[event_id % 6 + 1] || '/' || (user_id % 7) AS site
            FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 6 < 5 AND event_id % 17 <> 0 AND event_id % 19 <> 0)
        WHERE v >= 0) WHERE again = 1 GROUP BY 1"""


@query(f"SELECT strftime(h, '%Y-%m-%d %H:%M') AS observed, pm25_median, pm25_mean, pm25_min, pm25_max, observations, sites FROM ({_AIR})")
def q_air_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The national file of 24 spaced headers: filtered, refused by rule and by a key of seven columns, reduced to hours."""
    lake = scratch_lake(spark)
    ingest.ingest(spark, lake, _air(spark, sf_dir, f"{lake.root}/air"))
    rows = ingest.silver(lake, "air_quality_hourly_nyc")
    return rows.select(
        F.date_format("observation_ts_utc", "yyyy-MM-dd HH:mm").alias("observed"), "pm25_median", F.round("pm25_mean", 6).alias("pm25_mean"), "pm25_min", "pm25_max",
        F.col("site_observation_count").alias("observations"), F.col("site_count").alias("sites"),
    )


@query("SELECT event_id, ['Bronx', 'Kings', 'New York', 'Queens', 'Richmond', 'Albany'][event_id % 6 + 1] || '/' || lpad((user_id % 7)::VARCHAR, 4, '0') AS site_key FROM events")
def q_site_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("county", F.element_at(F.array(*map(F.lit, _COUNTY)), (F.col("event_id") % 6 + 1).cast("int")))
    return rows.select("event_id", d.composite_key("county", F.lpad((F.col("user_id") % 7).cast("string"), 4, "0")).alias("site_key"))


def _trips(spark: SparkSession, sf_dir: str, path: str) -> Contract:
    """An order is a trip; a tenth of the zones is unknown, some trips end before they start, some lie outside the file's month."""
    start = F.timestamp_add("MINUTE", F.col("o_orderkey") % 50000, F.lit("2024-01-01").cast("timestamp_ntz"))
    fare = F.round(F.col("o_totalprice") / 1000 - 10, 2)
    given = {
        "VendorID": F.lit(1), "tpep_pickup_datetime": start, "tpep_dropoff_datetime": F.timestamp_add("MINUTE", F.col("o_orderkey") % 61 - 1, start),
        "PULocationID": F.col("o_custkey") % 28 + 1, "DOLocationID": F.col("o_orderkey") % 25 + 1, "trip_distance": F.col("o_totalprice") / 1500, "fare_amount": fare, "total_amount": fare + 1,
    }
    contract = city.trips("2024-01", path)
    read(spark, sf_dir, "orders").select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in contract.source_schema())).write.parquet(path)
    return contract


_TRIPS = """
    SELECT *, strftime(pickup, '%Y-%m') <> '2024-01' AS outside, fare < 0 AS negative FROM (
        SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey % 50000) AS pickup, o_orderkey % 61 - 1 AS minutes, o_custkey % 28 + 1 AS pu, o_orderkey % 25 + 1 AS dropoff_zone, round(o_totalprice / 1000 - 10, 2) AS fare FROM orders)
    WHERE minutes > 0"""


@query(f"""
    SELECT source_file_month, pickup_zone_match_status, dropoff_zone_match_status, weather_match_status, air_quality_match_status, pickup_borough, outside AS pickup_outside_file_month,
           count(*) AS trips, sum(minutes)::BIGINT AS minutes, sum(round(temp * 1000)::BIGINT)::BIGINT AS temp_thousandths, sum(round(pm25_median * 100)::BIGINT)::BIGINT AS pm25_hundredths
    FROM (SELECT *, '2024-01' AS source_file_month, n_regionkey::VARCHAR AS pickup_borough,
                 CASE WHEN n_nationkey IS NULL THEN 'missing' ELSE 'matched' END AS pickup_zone_match_status, 'matched' AS dropoff_zone_match_status,
                 CASE WHEN w.h IS NULL THEN 'missing' ELSE 'matched' END AS weather_match_status, CASE WHEN a.h IS NULL THEN 'missing' ELSE 'matched' END AS air_quality_match_status
          FROM ({_TRIPS}) t LEFT JOIN nation ON pu = n_nationkey + 1 LEFT JOIN (SELECT * FROM ({_WEATHER}) WHERE n % 7 <> 0 AND n % 5 <> 0) w ON date_trunc('hour', pickup) = w.h
          LEFT JOIN ({_AIR}) a ON date_trunc('hour', pickup + INTERVAL 5 HOUR) = a.h) GROUP BY ALL""")
def q_city_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four sources taken in, and trips enriched by two roles of the zones, the local hour's weather and the UTC hour's air."""
    lake = scratch_lake(spark)
    nation = read(spark, sf_dir, "nation")
    zones = nation.select((F.col("n_nationkey") + 1).alias("LocationID"), F.col("n_regionkey").alias("Borough"), F.col("n_name").alias("Zone"), F.lit("Z").alias("service_zone"))
    sources = (_trips(spark, sf_dir, f"{lake.root}/trips"), city.zones(_file(zones, f"{lake.root}/zones", city.ZONE_FIELDS)), _weather(spark, sf_dir, f"{lake.root}/weather"), _air(spark, sf_dir, f"{lake.root}/air"))
    for c in sources:
        ingest.ingest(spark, lake, c)
    city.integrate(spark, lake, "keep")
    keys = ["source_file_month", *(f"{n}_match_status" for n in ("pickup_zone", "dropoff_zone", "weather", "air_quality")), "pickup_borough", "pickup_outside_file_month"]
    sums = {"minutes": F.col("trip_duration_minutes"), "temp_thousandths": F.col("weather_temp") * 1000, "pm25_hundredths": F.col("air_pm25_median") * 100}
    return lake.table(city.GOLD).read().groupBy(*keys).agg(F.count(F.lit(1)).alias("trips"), *(F.sum(F.round(c).cast("long")).alias(n) for n, c in sums.items()))


@query("""
    SELECT 'rows' AS metric, count(*) AS value FROM supplier UNION ALL SELECT 'nation_unmatched', count(*) FILTER (WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)) FROM supplier
    UNION ALL SELECT 'best_unmatched', count(*) FILTER (WHERE s_suppkey % 3 <> 0) FROM supplier""")
def q_gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an enrichment's observation counts while it is written; the key of one lookup is wider than the fact's."""
    supplier = read(spark, sf_dir, "supplier")
    best = supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    looks = [Lookup("nation", read(spark, sf_dir, "nation").where("n_regionkey <> 1").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint")), "s_nationkey", "n_nationkey", {"n_name": "nation"}), Lookup("best", best, "s_suppkey", "k", {"s_acctbal": "balance"})]
    seen, table = Observation(), scratch_lake(spark).table("gold")
    table.overwrite(observe(enrich(supplier, looks), looks, seen))
    verify(seen.get, looks, supplier.count())
    return from_rows(spark, sorted(seen.get.items()), "metric string, value long")


# -- gates -----------------------------------------------------------------------------------------


@query("""
    SELECT * FROM (VALUES ('a source that is not there', 'FileNotFoundError'), ('another number of rows than expected', 'ContractError'), ('the number of rows that is expected', 'passed'),
        ('a match that must be there', 'ContractError'), ('joins that multiply rows', 'ContractError'), ('a lookup whose key repeats', 'ContractError'), ('a dataset that is not registered', 'KeyError'),
        ('a format that is not known', 'ContractError'), ('a schema in another order', 'ContractError')) AS t(gate, outcome)""")
def q_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refuses, and how."""
    lake, path = scratch_lake(spark), f"{sf_dir}/orders.parquet"
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    must = [Lookup("nation", nation.where("n_regionkey <> 1"), "s_nationkey", "n_nationkey", on_miss="fail")]

    def joined(rows: int) -> None:
        seen = Observation()
        observe(enrich(supplier, must), must, seen).count()
        verify(seen.get | ({"nation_unmatched": 0} if rows else {}), must, rows or supplier.count())

    n = read(spark, sf_dir, "orders").count()
    gates = {
        "a source that is not there": lambda: ingest.ingest(spark, lake, order_contract(f"{lake.root}/none")),
        "another number of rows than expected": lambda: ingest.ingest(spark, lake, order_contract(path, expected_rows=n + 1)),
        "the number of rows that is expected": lambda: ingest.ingest(spark, lake, order_contract(path, expected_rows=n)),
        "a match that must be there": lambda: joined(0),
        "joins that multiply rows": lambda: joined(1),
        "a lookup whose key repeats": lambda: enrich(supplier, [Lookup("nation", nation.union(nation), "s_nationkey", "n_nationkey")]),
        "a dataset that is not registered": lambda: Registry((order_contract(path),)).select("nope"),
        "a format that is not known": lambda: order_contract(path, version="2") and Contract("k", "k", "orc", ()),
        "a schema in another order": lambda: ingest.ingest(spark, lake, replace(order_contract(path, version="3"), fields=order_contract(path).fields[::-1])),
    }
    out = []
    for name, gate in gates.items():
        try:
            gate()
            out.append((name, "passed"))
        except (ContractError, FileNotFoundError, KeyError) as e:
            out.append((name, type(e).__name__))
    return from_rows(spark, out, "gate string, outcome string")


@query("SELECT CASE WHEN l_linenumber % 5 = 0 THEN 'missing_a_b' WHEN n > 1 THEN 'duplicate_a_b' ELSE '' END AS reason, count(*) AS rows FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) GROUP BY 1")
def q_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of two columns, one of which may be null."""
    contract = Contract("k", "k", "parquet", (Field("a", "bigint"), Field("b", "int")), unique=("a", "b"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linenumber")).alias("b"))
    return quality.tag(rows, contract).groupBy(F.array_join(quality.REJECTS, ",").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT * FROM (VALUES ('archive', 'same_bytes', true), ('archive', 'same_name', true), ('archive', 'same_size', true), ('archive', 'single_entry', true), ('manifest', 'a.csv', true), ('manifest', 'b.csv', false), ('manifest', 'c.csv', false)) AS t(what, name, holds)")
def q_archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file against its digest and its archive."""
    lake = scratch_lake(spark)
    store, root = lake.store, f"{lake.root}/files"
    text = "\n".join(r.n_name for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect())
    for name in ("a.csv", "b.csv"):
        store.create(f"{root}/{name}", text)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", text)
    store.create(f"{root}/a.zip", packed.getvalue())
    store.create(f"{root}/sums", f"{store.sha256(f'{root}/a.csv')}  a.csv\n{'0' * 64}  b.csv\n{'1' * 64}  c.csv\n")
    found = [("archive", n, ok) for n, ok in store.verify_archive(f"{root}/a.zip", f"{root}/a.csv").items()]
    return from_rows(spark, found + [("manifest", n, ok) for n, ok in store.verify_manifest(f"{root}/sums", root).items()], "what string, name string, holds boolean")


# -- tables under change ---------------------------------------------------------------------------


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS order_month, CASE WHEN strftime(o_orderdate, '%Y') = '1996' THEN o_totalprice * 2 ELSE o_totalprice END AS price
    FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1997-05'""")
def q_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months that new rows have, and one more that is named, are replaced; other months' files stay."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("order_month"), F.col("o_totalprice").alias("price"))
    table = scratch_lake(spark).table("orders")
    for half in (0, 1):
        table.append(rows.where(F.col("o_orderkey") % 2 == half), ("order_month",))
    new = rows.where("order_month like '1996-%'").withColumn("price", F.col("price") * 2)
    table.replace_partitions(new, ("order_month",), ({"order_month": "1997-05"},))
    return table.read()


@query("""
    SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders
    WHERE o_orderstatus = 'O' OR o_orderstatus IN ('F', 'P') AND o_totalprice >= 50000""")
def q_compact_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices keep their names while the table is compacted and rows are deleted: one of them is replaced afterwards."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    table = scratch_lake(spark).table("orders")
    for status in ("O", "F", "P"):
        table.replace(rows.where(F.col("status") == status), status)
    table.compact(cluster_by=("o_orderkey",))
    table.delete("price < 50000")
    table.replace(rows.where("status = 'O'").withColumn("price", F.col("price") * 2), "O")
    table.compact()
    return table.read()


@query("SELECT o_orderkey, count(*) AS copies FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def q_concurrent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that another writer appends while a table is being compacted are there afterwards."""

    class Late(Lake):
        appended = False

        def stage(self, df, *args, **options):
            out = super().stage(df, *args, **options)
            if not self.appended:
                self.appended = True
                Lake(spark, self.root).table("orders").append(rows.where("o_orderkey % 2 = 0"))
            return out

    rows = read(spark, sf_dir, "orders").select("o_orderkey")
    root = scratch_lake(spark).root
    Lake(spark, root).table("orders").append(rows)
    Late(spark, root).table("orders").compact()
    return Lake(spark, root).table("orders").read().groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))


# -- files and reports -----------------------------------------------------------------------------


@query("SELECT codec, (SELECT count(*) FROM orders) AS rows, true AS has_groups FROM (SELECT unnest(['GZIP', 'SNAPPY', 'ZSTD']) AS codec)")
def q_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under each codec, by their footers."""
    lake, out = scratch_lake(spark), []
    for codec in ("snappy", "gzip", "zstd"):
        m = lake.table(codec).overwrite(read(spark, sf_dir, "orders"), compression=codec)
        found = profiling.file_profile(spark, f"{lake.root}/{m.segments[0].path}")
        out.append((",".join(found["codecs"]), found["rows"], found["row_groups"] >= found["files"] - found["empty_files"] > 0))
    return from_rows(spark, out, "codec string, rows long, has_groups boolean")


@query("""
    SELECT layout, (SELECT count(*) FROM orders) AS rows, (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders) AS result_rows, 3 AS samples, true AS median_holds, true AS plan_holds, true AS write_timed, true AS files_stable
    FROM (SELECT unnest(['flat', 'by_month']) AS layout)""")
def q_layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a comparison of layouts, as its file says: storage, timings, plans; a layout written again has as many files."""
    lake = scratch_lake(spark)
    ways = [layouts.Layout("flat"), layouts.Layout("by_month", ("order_month",))]
    source = lambda: shape(read(spark, sf_dir, "orders"), order_contract())
    report = layouts.compare(lake, source, ways, {"by_month": lambda t: t.groupBy("order_month").count()}, repeats=3)
    slim, plans = (json.loads(lake.store.read(p)) for p in layouts.write_report(lake.store, report, f"{lake.root}/report"))
    out = []
    for w in ways:
        kept, timed = slim["storage"][w.name], slim["queries"][w.name]["by_month"]
        again = layouts.materialize(lake, source, w)
        samples = sorted(timed["samples_ms"])
        out.append((w.name, kept["rows"], timed["rows"], len(samples), timed["median_ms"] == samples[1], "Scan parquet" in plans[f"{w.name}/by_month"], kept["write_seconds"] > 0, (again["files"], again["rows"]) == (kept["files"], kept["rows"])))
    return from_rows(spark, out, "layout string, rows long, result_rows long, samples int, median_holds boolean, plan_holds boolean, write_timed boolean, files_stable boolean")


@query(f"""
    SELECT command, status, CASE WHEN status = 'success' THEN n END AS accepted, CASE WHEN command = 'audit' THEN true END AS unique_keys
    FROM (SELECT count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 20000)), (VALUES ('ingest', 'success'), ('ingest again', 'skipped'), ('ingest --force', 'success'), ('audit', 'success')) AS t(command, status)""")
def q_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line over a file of contracts, which is the driver's own."""
    from lakeweave import __main__ as cli

    lake, out = scratch_lake(spark), []
    with tempfile.TemporaryDirectory() as own:
        Registry((order_contract(f"{sf_dir}/orders.parquet"),)).save(f"{own}/contracts.json")
        for name in ("ingest", "ingest again", "ingest --force", "audit"):
            said = io.StringIO()
            with contextlib.redirect_stdout(said):
                cli.main([name.split()[0], "--lake", lake.root, "--contracts", f"{own}/contracts.json", *(["--force"] if "--force" in name else [])], spark)
            row = json.loads(said.getvalue())
            if name == "audit":
                out.append((name, "success", row["orders"]["silver_rows"], row["orders"]["unique_keys"]))
            else:
                out.append((name, row[0]["status"], row[0]["rows_accepted"] if row[0]["status"] == "success" else None, None))
    return from_rows(spark, out, "command string, status string, accepted long, unique_keys boolean")
