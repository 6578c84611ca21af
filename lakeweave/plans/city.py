"""The city lakehouse as contracts: trips by month, zones, hourly weather, hourly air quality, and the trips enriched by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeweave.contracts import Contract, Field, Grain, Registry, Rule
from lakeweave.functions.derive import hour_bucket, zone_to_utc
from lakeweave.operators.enrich import Lookup, enrich, observe, verify
from lakeweave.operators.grain import lower_median
from lakeweave.plans import ingest, layouts
from lakeweave.sources.snapshots import Lake, Segment

GOLD = "gold_integrated_taxi_trips"
CITY_ZONE = "America/New_York"

# The published files' columns (name in the file, type, name here).
TRIP_FIELDS = (
    Field("VendorID", "int", "vendor_id"),
    Field("tpep_pickup_datetime", "timestamp", "pickup_ts_local"),
    Field("tpep_dropoff_datetime", "timestamp", "dropoff_ts_local"),
    Field("passenger_count", "bigint"),
    Field("trip_distance", "double"),
    Field("RatecodeID", "bigint", "ratecode_id"),
    Field("store_and_fwd_flag", "string"),
    Field("PULocationID", "int", "pu_location_id"),
    Field("DOLocationID", "int", "do_location_id"),
    Field("payment_type", "bigint"),
    *(Field(n, "double") for n in ("fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount", "congestion_surcharge")),
    Field("Airport_fee", "double", "airport_fee"),
)
ZONE_FIELDS = (Field("LocationID", "bigint", "location_id"), Field("Borough", "string", "borough"), Field("Zone", "string", "zone"), Field("service_zone", "string"))
WEATHER_FIELDS = tuple(Field(n, "bigint") for n in ("year", "month", "day", "hour")) + tuple(
    f
    for n, kind in {"temp": "double", "rhum": "bigint", "prcp": "double", "snwd": "double", "wdir": "bigint", "wspd": "double", "wpgt": "double", "pres": "double", "cldc": "bigint", "coco": "double"}.items()
    for f in (Field(n, kind), Field(f"{n}_source", "string"))
)
AIR_FIELDS = tuple(
    Field(n, kind, "pm25" if n == "Sample Measurement" else n.lower().replace(" ", "_"))
    for n, kind in {
        "State Code": "string", "County Code": "string", "Site Num": "string", "Parameter Code": "string", "POC": "string",
        "Latitude": "double", "Longitude": "double", "Datum": "string", "Parameter Name": "string", "Date Local": "string",
        "Time Local": "string", "Date GMT": "string", "Time GMT": "string", "Sample Measurement": "double", "Units of Measure": "string",
        "MDL": "double", "Uncertainty": "string", "Qualifier": "string", "Method Type": "string", "Method Code": "string",
        "Method Name": "string", "State Name": "string", "County Name": "string", "Date of Last Change": "date",
    }.items()
)
# The five counties of the city.
COUNTIES = ("Bronx", "Kings", "New York", "Queens", "Richmond")

_ID = ("vendor_id", "pickup_ts_local", "dropoff_ts_local", "pu_location_id", "do_location_id", "fare_amount", "total_amount")
_OUTSIDE = "pickup_ts_local is null or pickup_ts_local < date'{month}-01' or pickup_ts_local >= add_months(date'{month}-01', 1)"
_TRIP_WARNINGS = {
    "negative_fare": ("has_negative_fare", "coalesce(fare_amount < 0, false)"),
    "negative_total": ("has_negative_total", "coalesce(total_amount < 0, false)"),
    "pickup_outside_file_month": ("pickup_outside_file_month", _OUTSIDE),
    "extreme_trip_distance": ("extreme_trip_distance", "coalesce(trip_distance > 100, false)"),
}


def trips(month: str, path: str, expected_rows: int | None = None) -> Contract:
    """One month's file of trips. The fingerprint of a row is for audits, never a key."""
    return Contract(
        key=f"taxi_{month.replace('-', '_')}",
        logical_name="taxi_trips",
        format="parquet",
        path=path,
        fields=TRIP_FIELDS,
        parameters={"month": month},
        partition_by=("source_file_month",),
        expected_rows=expected_rows,
        time_semantics=CITY_ZONE,
        derive=(
            ("source_file_month", "'{month}'"),
            ("trip_duration_minutes", "cast((unix_timestamp(dropoff_ts_local) - unix_timestamp(pickup_ts_local)) / 60.0D as double)"),
            ("pickup_month", "date_format(pickup_ts_local, 'yyyy-MM')"),
            ("trip_id", f"sha2(to_json(struct({', '.join(_ID)}), map('ignoreNullFields', 'false')), 256)"),
            *_TRIP_WARNINGS.values(),
            ("quality_flags", "nullif(concat_ws(',', " + ", ".join(f"if({c}, '{n}', null)" for n, (c, _) in _TRIP_WARNINGS.items()) + "), '')"),
        ),
        rules=(
            Rule("missing_trip_time", "pickup_ts_local is null or dropoff_ts_local is null"),
            Rule("dropoff_not_after_pickup", "dropoff_ts_local <= pickup_ts_local"),
            *(Rule(n, c, "warn") for n, (c, _) in _TRIP_WARNINGS.items()),
        ),
    )


def zones(path: str, expected_rows: int | None = None) -> Contract:
    return Contract(
        key="taxi_zones", logical_name="taxi_zones", format="csv", path=path, fields=ZONE_FIELDS, unique=("location_id",), expected_rows=expected_rows,
        rules=(Rule("missing_attribute", "borough is null or zone is null or service_zone is null", "warn"),),
    )


def weather(path: str, expected_rows: int | None = None) -> Contract:
    return Contract(
        key="weather",
        logical_name="weather_hourly",
        format="csv",
        path=path,
        fields=WEATHER_FIELDS,
        unique=("observation_ts_local",),
        expected_rows=expected_rows,
        time_semantics="local_wall_clock_unconfirmed_timezone",
        derive=(
            ("observation_ts_local", "try_make_timestamp(cast(year as int), cast(month as int), cast(day as int), cast(hour as int), 0, 0)"),
            ("timestamp_semantics", "'local_wall_clock_unconfirmed_timezone'"),
        ),
    )


def air_quality(path: str, expected_rows: int | None = None, expected_hours: int | None = None) -> Contract:
    """The national file reduced to the city's fine dust, one row an hour. A station's observation must be the only one of
    its monitor, parameter and hour."""
    monitor = ("state_code", "county_code", "site_num", "parameter_code", "poc", "date_gmt", "time_gmt")
    return Contract(
        key="air_quality_nyc",
        logical_name="air_quality_hourly_nyc",
        format="csv",
        path=path,
        fields=AIR_FIELDS,
        expected_rows=expected_rows,
        time_semantics="UTC",
        where=f"`State Code` = '36' and `County Name` in ({', '.join(map(repr, COUNTIES))}) and `Parameter Code` = '88101'",
        derive=(
            ("observation_ts_utc", "if(date_gmt is null or time_gmt is null, null, try_to_timestamp(concat_ws(' ', date_gmt, time_gmt)))"),
            ("site_key", "concat_ws('/', county_name, site_num)"),
        ),
        rules=(Rule("missing_time", "observation_ts_utc is null"), Rule("missing_measurement", "pm25 is null"), Rule("negative_measurement", "pm25 < 0")),
        unique=monitor,
        grain=Grain(
            ("observation_ts_utc",),
            (
                ("pm25_median", lower_median("pm25")),
                ("pm25_mean", "avg(pm25)"),
                ("pm25_min", "min(pm25)"),
                ("pm25_max", "max(pm25)"),
                ("site_observation_count", "count(*)"),
                ("site_count", "count(distinct site_key)"),
            ),
            expected_hours,
        ),
    )


def registry(folder: str) -> Registry:
    """The published year's files below a folder, with their known row counts."""
    months = {"2024-01": 2964624, "2024-02": 3007526, "2024-03": 3582628}
    return Registry(
        (
            *(trips(m, f"{folder}/yellow_tripdata_{m}.parquet", n) for m, n in months.items()),
            zones(f"{folder}/taxi_zone_lookup.csv", 265),
            weather(f"{folder}/weather.csv", 8784),
            air_quality(f"{folder}/hourly_88101_2024.csv", 51885, 8784),
        )
    )


# Names of context columns in the enriched table, by their names in the source.
ZONE_COLUMNS = {"zone": "zone", "borough": "borough", "service_zone": "service_zone"}
WEATHER_COLUMNS = {
    "temp": "temp", "rhum": "relative_humidity", "prcp": "precipitation", "snwd": "snow_depth", "wdir": "wind_direction", "wspd": "wind_speed",
    "wpgt": "wind_peak_gust", "pres": "pressure", "cldc": "cloud_cover", "coco": "condition_code", "timestamp_semantics": "timestamp_semantics",
}
AIR_COLUMNS = {n: n for n in ("pm25_median", "pm25_mean", "pm25_min", "pm25_max", "site_count", "site_observation_count")}


def lookups(zone_rows: DataFrame, weather_rows: DataFrame, air_rows: DataFrame, on_zone_miss: str = "fail") -> list[Lookup]:
    return [
        Lookup("pickup_zone", zone_rows, "pu_location_id", "location_id", ZONE_COLUMNS, "pickup_", on_zone_miss),
        Lookup("dropoff_zone", zone_rows, "do_location_id", "location_id", ZONE_COLUMNS, "dropoff_", on_zone_miss),
        Lookup("weather", weather_rows, "pickup_hour_local", "observation_ts_local", WEATHER_COLUMNS, "weather_", keep_key="weather_observation_ts_local"),
        Lookup("air_quality", air_rows, "pickup_hour_utc", "observation_ts_utc", AIR_COLUMNS, "air_", keep_key="air_observation_ts_utc"),
    ]


def with_hours(trip_rows: DataFrame) -> DataFrame:
    """Trips with the local and the UTC hour of the pickup."""
    utc = zone_to_utc(F.col("pickup_ts_local"), CITY_ZONE)
    return trip_rows.withColumns({"pickup_hour_local": hour_bucket(F.col("pickup_ts_local")), "pickup_ts_utc": utc, "pickup_hour_utc": hour_bucket(utc)})


def integrate(spark: SparkSession, lake: Lake, on_zone_miss: str = "fail") -> dict:
    """Write the enriched trips, all or none; with 'quarantine', trips without a zone go to a table of their own."""
    zone_rows, weather_rows, air_rows = (ingest.silver(lake, n) for n in ("taxi_zones", "weather_hourly", "air_quality_hourly_nyc"))
    trip_rows = ingest.silver(lake, "taxi_trips")
    looks = lookups(zone_rows, weather_rows, air_rows, on_zone_miss)
    seen = Observation()
    gold = observe(enrich(with_hours(trip_rows), looks), looks, seen)
    lost = (F.col("pickup_zone_match_status") == "missing") | (F.col("dropoff_zone_match_status") == "missing")
    staged = lake.stage(gold.withColumn("_lost", lost & F.lit(on_zone_miss == "quarantine")), ("_lost", "source_file_month"))
    metrics = seen.get
    verify(metrics, looks, trip_rows.count())
    changes = []
    for name, value in ((GOLD, "false"), (f"quarantine_{GOLD}", "true")):
        at = f"{staged.path}/_lost={value}"
        there = [Segment(at, staged.path)] if lake.store.exists(f"{lake.root}/{at}") else []  # there is no folder without rows
        changes.append(lake.table(name).adopting(there, gold.schema, ("source_file_month",), mode="overwrite"))
    lake.commit(changes)
    return {"status": "success", "metrics": metrics, "gold_rows": lake.table(GOLD).read().count()}


def per_borough(trip_rows: DataFrame, zone_rows: DataFrame) -> DataFrame:
    """Trips by their pickup zone's borough. The planner broadcasts the zones by their size."""
    return trip_rows.join(zone_rows.select("location_id", "borough"), trip_rows.pu_location_id == F.col("location_id"), "left").groupBy("borough")


def queries(zone_rows: DataFrame) -> dict:
    """The three analytical queries over trips."""
    return {
        "trips_per_borough": lambda t: per_borough(t, zone_rows).agg(F.count(F.lit(1)).alias("trip_count")).orderBy("borough"),
        "average_fare_per_borough": lambda t: per_borough(t, zone_rows).agg(F.round(F.avg("fare_amount"), 6).alias("average_fare")).orderBy("borough"),
        "average_trip_duration_per_day": lambda t: t.groupBy(F.to_date("pickup_ts_local").alias("pickup_day")).agg(F.round(F.avg("trip_duration_minutes"), 6).alias("average_duration")).orderBy("pickup_day"),
    }


def benchmark(spark: SparkSession, lake: Lake, repeats: int = 3) -> dict:
    """The queries over an unpartitioned and a month-partitioned layout of the accepted trips."""
    ways = [layouts.Layout("layout_unpartitioned"), layouts.Layout("layout_by_pickup_month", ("pickup_month",))]
    return layouts.compare(lake, lambda: ingest.silver(lake, "taxi_trips"), ways, queries(ingest.silver(lake, "taxi_zones")), repeats)
