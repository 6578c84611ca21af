import hashlib
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeweave import __main__ as cli
from lakeweave.contracts import Contract, ContractError, Field, Rule
from lakeweave.plans import city, ingest
from lakeweave.sources import storage
from lakeweave.sources.reading import read_source
from lakeweave.sources.snapshots import Conflict, Lake, Segment
from lakeweave.streaming import arrivals


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- tables --------------------------------------------------------------------------------------


def test_versions_replace_append_and_vacuum(spark, lake):
    t = lake.table("t")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "m string, v int")
    t.replace(a.where("m = 'x'"), "x", ("m",))
    t.replace(a.where("m = 'y'"), "y", ("m",))
    t.replace(spark.createDataFrame([("x", 7)], "m string, v int"), "x", ("m",))
    assert rows(t.read()) == [("x", 7), ("y", 2)] and rows(t.read(2)) == [("x", 1), ("y", 2)]
    t.append(spark.createDataFrame([("z", 3, 1.5)], "m string, v int, w double"))
    assert rows(t.read()) == [("x", 7, None), ("y", 2, None), ("z", 3, 1.5)]
    with pytest.raises(ValueError, match="can't become"):
        t.append(spark.createDataFrame([("z", "three")], "m string, v string"))
    t.overwrite(t.read(), ("m",))
    assert t.active_stats()["files"] == 3
    t.overwrite(t.read(), ("m",))
    assert t.active_stats()["files"] == 3
    assert t.vacuum() > 0 and rows(t.read()) == [("x", 7, None), ("y", 2, None), ("z", 3, 1.5)]
    t.compact(cluster_by=("v",))
    assert rows(t.read()) == [("x", 7, None), ("y", 2, None), ("z", 3, 1.5)]
    t.delete("v = 7 or w > 1")
    assert rows(t.read()) == [("y", 2, None)]
    with pytest.raises(KeyError):
        t.read(1)


def test_numeric_looking_partitions_keep_their_type(spark, lake):
    lake.table("t").overwrite(spark.createDataFrame([("1995", 1)], "year string, v int"), ("year",))
    assert lake.table("t").read().dtypes == [("year", "string"), ("v", "int")]


def test_a_crash_before_the_commit_changes_nothing(spark, lake):
    t = lake.table("t")
    t.overwrite(spark.range(3))
    lake.stage(spark.range(9))  # written, never committed
    assert t.read().count() == 3
    assert t.vacuum() == 1


def test_lost_races_are_told(spark, lake, monkeypatch):
    t = lake.table("t")
    t.overwrite(spark.range(1))
    stale = t.manifest()
    t.append(spark.range(1))
    monkeypatch.setattr(t, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        t.append(spark.range(1))


def test_rewriting_keeps_slices(spark, lake):
    t = lake.table("t")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "m string, v int")
    for k in (1, 2):
        t.replace(a, f"s{k}", ("m",))
    for rewrite in (t.compact, lambda: t.delete("v = 1"), lambda: t.compact(cluster_by=("v",))):
        rewrite()
        assert {s.slice for s in t.manifest().segments} == {"s1", "s2"}
        t.replace(a, "s1")
        assert t.read().where("v = 2").count() == 2 and t.read().where("v = 1").count() in (1, 2)
    t.delete("true")
    assert t.read().count() == 0 and t.manifest().segments == ()


def test_what_is_appended_while_a_table_is_rewritten_stays(spark, lake, monkeypatch):
    t, stage, seen = lake.table("t"), lake.stage, []
    t.replace(spark.range(10), "a")

    def late(df, *args, **more):
        out = stage(df, *args, **more)
        if not seen:
            seen.append(1)
            t.append(spark.range(100, 110))
        return out

    monkeypatch.setattr(lake, "stage", late)
    t.compact()
    assert t.read().count() == 20
    # what was replaced meanwhile is not brought back
    seen.clear()
    monkeypatch.setattr(lake, "stage", lambda df, *a, **k: (out := stage(df, *a, **k), seen or (seen.append(1), t.replace(spark.range(3), "a")))[0])
    t.delete("id = 105")
    assert t.read().count() == 3 + 9


def test_a_lost_folder_is_an_error(spark, lake):
    t = lake.table("t")
    t.append(spark.range(10))
    t.append(spark.range(10))
    lake.store.delete(f"{lake.root}/{t.manifest().segments[0].path}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        t.read().count()


def test_several_tables_change_together(spark, lake, monkeypatch):
    one, two = lake.table("one"), lake.table("two")
    one.append(spark.range(1))

    def changes():
        out = []
        for t in (one, two):
            staged = lake.stage(spark.range(5))
            out.append(t.adopting([Segment(staged.path, staged.path)], staged.schema))
        return out

    create = lake.store.create
    monkeypatch.setattr(lake.store, "create", lambda path, text: (_ for _ in ()).throw(OSError("dead")) if "/transactions/" in path else create(path, text))
    with pytest.raises(OSError):  # the writer dies between its manifests and its commit
        lake.commit(changes())
    monkeypatch.setattr(lake.store, "create", create)
    assert one.read().count() == 1 and not two.exists() and one.versions() == [1]
    one.append(spark.range(1))  # ends what was left open
    assert one.read().count() == 2 and one.versions() == [1, 3]
    lake.commit(changes())
    assert one.read().count() == 7 and two.read().count() == 5
    assert one.vacuum() >= 1 and one.read().count() == 7 and two.read().count() == 5


def test_partitions_are_replaced_by_value(spark, lake):
    t = lake.table("t")
    t.append(spark.createDataFrame([("a/b", 1), ("y", 2), ("z", 3)], "m string, v int"), ("m",))
    t.append(spark.createDataFrame([("y", 20)], "m string, v int"))
    t.replace_partitions(spark.createDataFrame([("y", 7), ("a/b", 8)], "m string, v int"), ("m",))
    assert rows(t.read()) == [("a/b", 8), ("y", 7), ("z", 3)]
    t.replace_partitions(spark.createDataFrame([], "m string, v int"), ("m",), ({"m": "z"},))
    assert rows(t.read()) == [("a/b", 8), ("y", 7)]
    t.compact()
    t.replace_partitions(spark.createDataFrame([("y", 9)], "m string, v int"), ("m",))
    assert rows(t.read()) == [("a/b", 8), ("y", 9)]


def test_many_appends_are_one_scan(spark, lake):
    t = lake.table("t")
    for i in range(12):
        t.append(spark.createDataFrame([(f"m{i % 3}", i)], "m string, v int"), ("m",))
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and t.read().count() == 12


def test_empty_tables_have_a_schema(spark, lake):
    lake.table("t").create(spark.range(0).schema)
    lake.table("t").create(spark.createDataFrame([], "other int").schema)
    assert lake.table("t").read().dtypes == [("id", "bigint")] and lake.table("t").read().count() == 0
    with pytest.raises(KeyError):
        lake.table("none").read()


# -- sources -------------------------------------------------------------------------------------


def test_refused_sources(spark, tmp_path):
    contract = Contract("c", "c", "parquet", (Field("a", "int"), Field("b", "string")))
    for i, (df, say) in enumerate(
        [
            (spark.createDataFrame([(1, "x")], "a int, c string"), "column 'b' is missing"),
            (spark.createDataFrame([("x", 1)], "b string, a int"), "another order"),
            (spark.createDataFrame([(1.5, "x")], "a double, b string"), "is double, not int"),
            (spark.createDataFrame([(1, "x", 2)], "a int, b string, z int"), "'z' is not declared"),
        ]
    ):
        df.write.parquet(f"{tmp_path}/{i}")
        with pytest.raises(ContractError, match=say):
            read_source(spark, contract, f"{tmp_path}/{i}")
    with pytest.raises(FileNotFoundError):
        read_source(spark, contract, f"{tmp_path}/none")
    csv = Contract("c", "c", "csv", (Field("a", "int"), Field("b", "string")))
    (tmp_path / "x.csv").write_text("a,c\n1,x\n")
    with pytest.raises(ContractError, match="'b' is missing"):
        read_source(spark, csv, str(tmp_path / "x.csv"))
    (tmp_path / "y.csv").write_text("a,b\nnope,x\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|FAILED_READ_FILE"):
        read_source(spark, csv, str(tmp_path / "y.csv")).collect()


def test_integrity_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 3_000_000)
    digest = hashlib.sha256(b"x" * 3_000_000).hexdigest()
    assert storage.Store(spark).sha256(str(tmp_path / "a.csv")) == digest
    (tmp_path / "sums").write_text(f"{digest}  a.csv\n{'0' * 64}  b.csv\n")
    assert storage.Store(spark).verify_manifest(str(tmp_path / "sums"), str(tmp_path)) == {"a.csv": True, "b.csv": False}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.csv", "a.csv")
    assert all(storage.Store(spark).verify_archive(str(tmp_path / "a.zip"), str(tmp_path / "a.csv")).values())
    (tmp_path / "a.csv").write_bytes(b"y" * 3_000_000)
    assert storage.Store(spark).verify_archive(str(tmp_path / "a.zip"), str(tmp_path / "a.csv")) == {"single_entry": True, "same_name": True, "same_size": True, "same_bytes": False}


# -- runs ----------------------------------------------------------------------------------------

SMALL = (Field("id", "bigint"), Field("v", "int"))


def small(path, key="s", **more):
    return Contract(key, "small", "parquet", SMALL, path, rules=(Rule("negative", "v < 0"), Rule("zero", "v = 0", "warn")), **more)


def test_runs_are_idempotent_and_told(spark, lake, tmp_path):
    path = f"{tmp_path}/s"
    spark.createDataFrame([(1, 1), (2, -1), (3, 0)], "id bigint, v int").write.parquet(path)
    first = ingest.ingest(spark, lake, small(path))
    assert (first["status"], first["rows_read"], first["rows_accepted"], first["rows_quarantined"], first["rows_warned"]) == ("success", 3, 2, 1, 1)
    assert ingest.ingest(spark, lake, small(path))["status"] == "skipped"
    assert ingest.ingest(spark, lake, small(path, version="2"))["status"] == "success"
    assert ingest.ingest(spark, lake, small(path), force=True)["status"] == "success"
    assert ingest.silver(lake, "small").count() == 2 and ingest.quarantine(lake, "small").count() == 1
    # another source of the same table: its slice alone changes, and its old rejects go
    other = f"{tmp_path}/o"
    spark.createDataFrame([(9, -5)], "id bigint, v int").write.parquet(other)
    ingest.ingest(spark, lake, small(other, "o"))
    assert ingest.silver(lake, "small").count() == 2 and ingest.quarantine(lake, "small").count() == 2
    spark.createDataFrame([(9, 5)], "id bigint, v int").write.mode("overwrite").parquet(other)
    ingest.ingest(spark, lake, small(other, "o"))
    assert sorted(r.id for r in ingest.silver(lake, "small").collect()) == [1, 3, 9] and [r.id for r in ingest.quarantine(lake, "small").collect()] == [2]
    assert ingest.audit(lake, small(path))["last_run"] == {"rows_read": 3, "rows_accepted": 2, "rows_quarantined": 1, "rows_warned": 1}
    with pytest.raises(ContractError, match="4 are expected"):
        ingest.ingest(spark, lake, small(path, expected_rows=4, version="3"))
    assert ingest.silver(lake, "small").count() == 3
    said = ingest.ledger(lake).groupBy("status").count()
    assert {r.status: r["count"] for r in said.collect()} == {"success": 5, "skipped": 1, "failed": 1}
    assert "4 are expected" in ingest.ledger(lake).where("status = 'failed'").first().error_message


def test_a_source_without_good_rows(spark, lake, tmp_path):
    spark.createDataFrame([(1, -1)], "id bigint, v int").write.parquet(f"{tmp_path}/s")
    ingest.ingest(spark, lake, small(f"{tmp_path}/s"))
    assert ingest.silver(lake, "small").count() == 0 and ingest.quarantine(lake, "small").first().quarantine_reason == ["negative"]
    spark.createDataFrame([], "id bigint, v int").write.parquet(f"{tmp_path}/e")
    assert ingest.ingest(spark, lake, small(f"{tmp_path}/e", "e"))["rows_read"] == 0


def test_stream_of_arriving_files(spark, lake, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(1, 1), (2, -1)], "id bigint, v int").coalesce(1).write.parquet(str(folder))
    arrivals.land(spark, lake, small(str(folder)), str(folder), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(3, 3)], "id bigint, v int").coalesce(1).write.mode("append").parquet(str(folder))
    arrivals.land(spark, lake, small(str(folder)), str(folder), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in ingest.silver(lake, "small").collect()) == [1, 3] and [r.id for r in ingest.quarantine(lake, "small").collect()] == [2]
    with pytest.raises(ContractError):
        arrivals.arriving(spark, small(str(folder), unique=("id",)), str(folder))


def test_hourly_stream(spark, tmp_path):
    s = datetime(2024, 1, 1)
    spark.createDataFrame([(s + timedelta(minutes=30 * i), float(i)) for i in range(12)], "ts timestamp_ntz, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = arrivals.hourly(spark.readStream.schema("ts timestamp_ntz, v double").parquet(f"{tmp_path}/in"), "ts", {"n": "count(*)", "total": "sum(v)"})
    stream.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    got = spark.table("hours").orderBy("hour").collect()
    assert [(r.n, r.total) for r in got] == [(2, 4.0 * i + 1) for i in range(len(got))] and len(got) >= 3


# -- the city ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def city_files(spark, tmp_path_factory):
    """A few rows of every source, with all that can be wrong in them."""
    folder = tmp_path_factory.mktemp("city")
    s = datetime(2024, 1, 15, 10, 20)
    base = dict(VendorID=1, passenger_count=1, trip_distance=2.0, RatecodeID=1, store_and_fwd_flag="N", PULocationID=1, DOLocationID=2, payment_type=1, fare_amount=10.0, extra=0.0, mta_tax=0.5, tip_amount=1.0, tolls_amount=0.0, improvement_surcharge=1.0, total_amount=12.5, congestion_surcharge=0.0, Airport_fee=0.0)
    base |= dict(tpep_pickup_datetime=s, tpep_dropoff_datetime=s + timedelta(minutes=12, seconds=30))
    trips = [base, base | dict(fare_amount=-3.0, total_amount=-3.0, trip_distance=100.01), base | dict(tpep_dropoff_datetime=s), base | dict(tpep_pickup_datetime=None), base | dict(tpep_pickup_datetime=datetime(2023, 12, 31, 23, 59), tpep_dropoff_datetime=datetime(2024, 1, 1)), base | dict(PULocationID=3, passenger_count=None)]
    schema = city.trips("2024-01", "").source_schema()
    for month, take in (("2024-01", trips), ("2024-02", [base | dict(tpep_pickup_datetime=s + timedelta(31), tpep_dropoff_datetime=s + timedelta(32))])):
        spark.createDataFrame([tuple(t[n] for n in schema.fieldNames()) for t in take], schema).coalesce(1).write.parquet(f"{folder}/yellow_tripdata_{month}.parquet")
    (folder / "taxi_zone_lookup.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Queens,A,Yellow\n2,Bronx,B,\n3,Queens,C,Boro\n4,X,D,E\n4,X,D,E\n,Y,F,G\n")
    names = [f.source for f in city.WEATHER_FIELDS]
    lines = [dict(year=2024, month=1, day=15, hour=h, temp=1.5 + h, temp_source="s") for h in (9, 10)] + [dict(year=2024, month=2, day=30, hour=1), dict(year=2024, month=1, day=1)]
    (folder / "weather.csv").write_text("\n".join([",".join(names), *(",".join(str(x.get(n, "")) for n in names) for x in lines)]) + "\n")
    names = [f.source for f in city.AIR_FIELDS]
    one = {"State Code": "36", "County Code": "005", "Site Num": "0110", "Parameter Code": "88101", "POC": "1", "Date GMT": "2024-01-15", "Time GMT": "15:00", "Sample Measurement": 4.0, "County Name": "Bronx"}
    lines = [one, one | {"Site Num": "0111", "Sample Measurement": 6.0}, one | {"County Name": "Kings", "County Code": "047", "Sample Measurement": 9.0}, one | {"Time GMT": "16:00", "Sample Measurement": -1}, one | {"Time GMT": "nope", "POC": "2"}]
    lines += [one | {"Time GMT": "17:00"}] * 2 + [one | {"State Code": "34"}, one | {"County Name": "Albany"}, one | {"Parameter Code": "88502"}, one | {"County Name": ""}]
    (folder / "hourly_88101_2024.csv").write_text("\n".join([",".join(names), *(",".join(str(x.get(n, "")) for n in names) for x in lines)]) + "\n")
    return str(folder)


def test_the_city_end_to_end(spark, lake, city_files):
    contracts = [city.trips("2024-01", f"{city_files}/yellow_tripdata_2024-01.parquet"), city.trips("2024-02", f"{city_files}/yellow_tripdata_2024-02.parquet")]
    contracts += [city.zones(f"{city_files}/taxi_zone_lookup.csv"), city.weather(f"{city_files}/weather.csv"), city.air_quality(f"{city_files}/hourly_88101_2024.csv", 7, 1)]
    said = {c.key: ingest.ingest(spark, lake, c) for c in contracts}
    counts = {k: (r["rows_read"], r["rows_accepted"], r["rows_quarantined"], r["rows_warned"]) for k, r in said.items()}
    assert counts == {"taxi_2024_01": (6, 4, 2, 2), "taxi_2024_02": (1, 1, 0, 0), "taxi_zones": (6, 3, 3, 1), "weather": (4, 2, 2, 0), "air_quality_nyc": (7, 3, 4, 0)}
    silver = ingest.silver(lake, "taxi_trips")
    assert len(silver.columns) == 33 and {r.source_file_month for r in silver.collect()} == {"2024-01", "2024-02"}
    flags = {r.quality_flags for r in silver.collect()}
    assert flags == {None, "negative_fare,negative_total,extreme_trip_distance", "pickup_outside_file_month"}
    assert silver.where("fare_amount = 10 and source_file_month = '2024-01' and pickup_month = '2024-01'").first().trip_duration_minutes == 12.5
    assert len(ingest.silver(lake, "taxi_zones").columns) == 9 and len(ingest.silver(lake, "weather_hourly").columns) == 31
    (air,) = ingest.silver(lake, "air_quality_hourly_nyc").collect()
    assert len(air) == 7 and (air.pm25_median, air.pm25_min, air.pm25_max, air.site_observation_count, air.site_count) == (6.0, 4.0, 9.0, 3, 3)
    out = city.integrate(spark, lake)
    assert out["gold_rows"] == 5 and out["metrics"] == {"rows": 5, "pickup_zone_unmatched": 0, "dropoff_zone_unmatched": 0, "weather_unmatched": 2, "air_quality_unmatched": 2}
    gold = lake.table(city.GOLD).read()
    # the reference's 63 columns and both observation times
    assert len(gold.columns) == 65 and {"weather_observation_ts_local", "air_observation_ts_utc"} < set(gold.columns)
    hit = gold.where("weather_match_status = 'matched'").first()
    assert (hit.weather_temp, hit.air_pm25_median, hit.pickup_borough, hit.dropoff_borough) == (11.5, 6.0, "Queens", "Bronx")
    report = city.benchmark(spark, lake, repeats=1)
    for qs in report["queries"].values():
        assert qs["trips_per_borough"]["rows"] == 1 and qs["average_trip_duration_per_day"]["rows"] == 3
    assert city.queries(ingest.silver(lake, "taxi_zones"))["trips_per_borough"](silver).collect()[0].trip_count == 5


def test_trips_without_a_zone(spark, lake, city_files):
    for c in (city.trips("2024-01", f"{city_files}/yellow_tripdata_2024-01.parquet"), city.weather(f"{city_files}/weather.csv"), city.air_quality(f"{city_files}/hourly_88101_2024.csv")):
        ingest.ingest(spark, lake, c)
    lake.table("silver_taxi_zones").overwrite(spark.createDataFrame([(1, "A", "Q", "Y"), (2, "B", "Q", "Y")], "location_id bigint, zone string, borough string, service_zone string"))
    with pytest.raises(ContractError, match="pickup_zone"):
        city.integrate(spark, lake)
    assert not lake.table(city.GOLD).exists()
    assert city.integrate(spark, lake, "keep")["gold_rows"] == 4
    assert city.integrate(spark, lake, "quarantine")["gold_rows"] == 3
    assert lake.table(f"quarantine_{city.GOLD}").read().select("pu_location_id").first()[0] == 3


def test_command_line(spark, lake, city_files, tmp_path, capsys):
    contracts = tmp_path / "own.json"
    from lakeweave.contracts import Registry

    Registry((city.zones(f"{city_files}/taxi_zone_lookup.csv"),)).save(contracts)
    assert cli.main(["ingest", "--lake", lake.root, "--contracts", str(contracts)], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["rows_accepted"] == 3
    assert cli.main(["ingest", "--lake", lake.root, "--contracts", str(contracts)], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["status"] == "skipped"
    assert cli.main(["audit", "--lake", lake.root, "--contracts", str(contracts)], spark) == 0
    assert json.loads(capsys.readouterr().out)["taxi_zones"]["unique_keys"] is True
    with pytest.raises(KeyError, match="taxi_zones"):
        cli.main(["ingest", "--lake", lake.root, "--data", city_files, "--dataset", "nope"], spark)


def test_published_registry():
    assert city.registry("/data").keys() == ["air_quality_nyc", "taxi_2024_01", "taxi_2024_02", "taxi_2024_03", "taxi_zones", "weather"]
    assert sum(c.expected_rows for c in city.registry("/data").select("all")) == 2964624 + 3007526 + 3582628 + 265 + 8784 + 51885


def test_borough_queries_broadcast_the_zones(spark, lake):
    lake.table("zones").overwrite(spark.createDataFrame([(1, "Q")], "location_id bigint, borough string"))
    trips = spark.createDataFrame([(1, 2.0)], "pu_location_id int, fare_amount double")
    plan = city.per_borough(trips, lake.table("zones").read()).agg(F.count("*"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
