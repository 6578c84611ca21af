from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lakeweave.contracts import Contract, ContractError, Field, Grain, Registry, Rule, load
from lakeweave.functions import derive as d
from lakeweave.operators import asof, dedup, profiling, quality
from lakeweave.operators.enrich import Lookup, enrich, observe, prove_unique, unmatched_keys, verify
from lakeweave.operators.grain import lower_median, reduce_to
from lakeweave.operators.shaping import shape
from lakeweave.plans import layouts


def at(text):
    return datetime.fromisoformat(text)


TRIP = Contract(
    "trips", "trips", "parquet",
    (Field("Start", "timestamp_ntz", "start"), Field("End", "timestamp_ntz", "end"), Field("fare", "double"), Field("id", "bigint")),
    derive=(("minutes", "(unix_timestamp(end) - unix_timestamp(start)) / 60.0D"),),
    rules=(Rule("missing", "start is null or end is null"), Rule("backwards", "end <= start"), Rule("negative_fare", "fare < 0", "warn")),
)


def test_time_order_rules(spark):
    s = at("2024-01-01")
    rows = [(s, s - timedelta(1), 1.0, 1), (s, s, 1.0, 2), (s, s + timedelta(minutes=3), 1.0, 3), (None, s, 1.0, 4), (s, None, 1.0, 5), (None, None, 1.0, 6), (s, s + timedelta(1), -0.01, 7), (s, s + timedelta(1), None, 8), (s, s + timedelta(1), 0.0, 9)]
    tagged = quality.tag(shape(spark.createDataFrame(rows, "Start timestamp_ntz, End timestamp_ntz, fare double, id bigint"), TRIP), TRIP)
    got = {r.id: (r._rejects, r._warnings) for r in tagged.collect()}
    assert got == {1: (["backwards"], []), 2: (["backwards"], []), 3: ([], []), 4: (["missing"], []), 5: (["missing"], []), 6: (["missing"], []), 7: ([], ["negative_fare"]), 8: ([], []), 9: ([], [])}
    seen = Observation()
    assert quality.accepted(quality.counts(tagged, seen)).count() == 4
    assert seen.get == {"rows_read": 9, "rows_accepted": 4, "rows_quarantined": 5, "rows_warned": 1}
    assert {r.id: r.quarantine_reason for r in quality.quarantined(tagged).collect()}[4] == ["missing"]
    assert {r.id: r.minutes for r in quality.accepted(tagged).collect()}[3] == 3.0
    with pytest.raises(ContractError):
        quality.reconcile({"rows_read": 3, "rows_accepted": 1, "rows_quarantined": 1}, TRIP)


def test_repeated_and_missing_keys(spark):
    contract = Contract("k", "k", "parquet", (Field("id", "bigint"), Field("v", "int")), rules=(Rule("bad", "v < 0"),), unique=("id",))
    tagged = quality.tag(spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 1), (None, 2), (3, -1), (3, 1)], "id bigint, v int"), contract)
    got = sorted((r.id or 0, r.v, r._rejects) for r in tagged.collect())
    assert got == [(0, 1, ["missing_id"]), (0, 2, ["missing_id"]), (1, 1, []), (2, 1, ["duplicate_id"]), (2, 1, ["duplicate_id"]), (3, -1, ["bad"]), (3, 1, [])]


def test_composite_key_is_enforced(spark):
    contract = Contract("k", "k", "parquet", (Field("a", "int"), Field("b", "int")), unique=("a", "b"))
    tagged = quality.tag(spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, None)], "a int, b int"), contract)
    assert sorted(str(r._rejects) for r in tagged.collect()) == ["['duplicate_a_b']", "['duplicate_a_b']", "['missing_a_b']", "[]"]


def test_month_edges(spark):
    rows = [("2023-12-31T23:59:59.999999",), ("2024-01-01T00:00:00",), ("2024-01-31T23:59:59.999999",), ("2024-02-01T00:00:00",), (None,)]
    df = spark.createDataFrame([(at(t) if t else None,) for (t,) in rows], "t timestamp_ntz")
    assert [r[0] for r in df.select(d.outside_month("t", "2024-01")).collect()] == [True, False, False, True, True]


def test_calendar_parts_and_text_never_raise(spark):
    df = spark.createDataFrame([(2024, 2, 29, 5), (2024, 2, 30, 5), (2024, 1, 1, 24), (2024, None, 1, 1)], "y bigint, m bigint, d bigint, h bigint")
    assert [r[0] for r in df.select(d.timestamp_from_parts("y", "m", "d", "h").cast("string")).collect()] == ["2024-02-29 05:00:00", None, None, None]
    text = spark.createDataFrame([("2024-01-01", "05:00"), ("nope", "05:00"), (None, "05:00"), ("2024-01-01", None)], "a string, b string")
    assert [r[0] for r in text.select(d.timestamp_from_text("a", "b").cast("string")).collect()] == ["2024-01-01 05:00:00", None, None, None]


def test_flags(spark):
    df = spark.createDataFrame([(0, 0.0), (1, -1.0), (2, None), (3, 101.0)], "id int, x double")
    names = d.flags([("low", d.below("x", 0)), ("any", F.col("id") >= 3), ("high", d.above("x", 100))])
    assert [r[0] for r in df.select(d.flag_text(names)).collect()] == [None, "low", None, "any,high"]


def test_clock_changes(spark):
    df = spark.createDataFrame([(at("2024-03-10T02:30"),), (at("2024-11-03T01:30"),), (at("2024-07-01T12:00"),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(d.zone_to_utc(F.col("t"), "America/New_York").cast("string")).collect()] == ["2024-03-10 07:30:00", "2024-11-03 05:30:00", "2024-07-01 16:00:00"]


def test_fingerprint_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b"), ("a|b", None, None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(d.row_fingerprint("x", "y", "z")).collect()}) == 4
    assert len({r[0] for r in df.select(d.plain_fingerprint("x", "y", "z")).collect()}) == 2


def test_lower_median_and_distinct_sites(spark):
    rows = [(1, 5.0, "a/1"), (2, 1.0, "a/1"), (2, 3.0, "b/1"), (3, 1.0, "a/1"), (3, 2.0, "a/1"), (3, 9.0, "a/1"), (4, 1.0, "a/1"), (4, 2.0, "a/1"), (4, 3.0, "b/1"), (4, 4.0, "b/1")]
    out = reduce_to(spark.createDataFrame(rows, "k int, x double, site string"), Grain(("k",), (("m", lower_median("x")), ("sites", "count(distinct site)"))))
    assert sorted(map(tuple, out.collect())) == [(1, 5.0, 1), (2, 1.0, 2), (3, 2.0, 1), (4, 2.0, 2)]


def test_lower_median_of_large_groups(spark):
    """Partial results of many tasks; each group's median is known."""
    rows = spark.range(0, 240_000, numPartitions=16).selectExpr("id % 4 as k", "cast((id div 4) * 7919 % 60000 as double) + id % 4 as x")
    out = reduce_to(rows, Grain(("k",), (("m", lower_median("x")),)))
    assert sorted(map(tuple, out.collect())) == [(k, 29999.0 + k) for k in range(4)]


def test_lookups_keep_every_row_once(spark):
    fact = spark.createDataFrame([(1, 10), (2, 99), (3, None), (4, 10)], "id int, k int")
    dim = spark.createDataFrame([(10, "x"), (11, "y"), (None, "z")], "k int, name string")
    looks = [Lookup("a", dim, "k", "k", {"name": "name"}, "a_"), Lookup("b", dim, "k", "k", {"name": "name"}, "b_", keep_key="b_key")]
    for limit in (10, 0):
        out = enrich(fact, looks, max_broadcast_rows=limit)
        assert out.columns == ["id", "k", "a_name", "b_name", "b_key", "a_match_status", "b_match_status"]
        seen = Observation()
        rows = {r.id: tuple(r)[2:] for r in observe(out, looks, seen).collect()}
        assert rows == {1: ("x", "x", 10, "matched", "matched"), 2: (None, None, None, "missing", "missing"), 3: (None, None, None, "missing", "missing"), 4: ("x", "x", 10, "matched", "matched")}
        assert seen.get == {"rows": 4, "a_unmatched": 2, "b_unmatched": 2}
    verify(seen.get, looks, 4)
    with pytest.raises(ContractError):
        verify(seen.get, looks, 3)
    with pytest.raises(ContractError):
        verify(seen.get, [Lookup("a", dim, "k", "k", {}, on_miss="fail")], 4)
    with pytest.raises(ContractError):
        enrich(fact, [Lookup("a", dim.union(dim), "k", "k", {"name": "name"})])
    assert prove_unique(dim, "k", "dim")[0] == 2
    assert sorted(str(r[0]) for r in unmatched_keys(fact, "k", dim, "k").collect()) == ["99", "None"]


def test_asof_edges(spark):
    left = spark.createDataFrame([(i, at(t) if t else None) for i, t in enumerate(["2024-01-01T10:00", "2024-01-01T10:59:59", "2024-01-01T11:00", "2024-01-01T11:00:00.000001", "2024-01-01T09:59", None, "2024-01-01T13:30"])], "id int, t timestamp_ntz")
    right = spark.createDataFrame([(at("2024-01-01T10:00"), 1.0), (at("2024-01-01T10:00"), 2.0), (None, 5.0), (at("2024-01-01T12:45"), 3.0), (at("2024-01-01T13:15"), 4.0)], "ts timestamp_ntz, v double")
    got = {r.id: (r.v, r.lag_minutes) for r in asof.asof_backward(left, right, "t", "ts", columns={"v": "v"}).collect()}
    assert got == {0: (2.0, 0.0), 1: (2.0, pytest.approx(59 + 59 / 60)), 2: (2.0, 60.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (4.0, 15.0)}


def test_duplicates_are_kept_aside(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, fp string")
    good, bad = dedup.split_duplicates(df, "fp", ("id",))
    assert sorted(r.id for r in good.collect()) == [1, 3] and [r.id for r in bad.collect()] == [2]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [2]), (2, "b", None)], "id int, s string, l array<int>")
    out = profiling.profile_columns(df, {"twos": "id = 2"})
    assert out["rows"] == 3 and out["counts"] == {"twos": 2}
    assert out["columns"]["id"] == {"nulls": 0, "min": 1, "max": 2, "distinct_estimate": 2} and out["columns"]["l"] == {"nulls": 1}
    assert sorted(map(tuple, profiling.distinct_values(df, ["id", "s"]).collect())) == [("id", "1"), ("id", "2"), ("s", "a"), ("s", "b")]
    assert tuple(profiling.key_profile(df, "id", "s").first()) == (3, 3, 0, 1)


def test_file_profile(spark, sf_dir):
    out = profiling.file_profile(spark, f"{sf_dir}/orders.parquet")
    assert out["rows"] == 1500 and out["row_groups"] >= 1 and out["files"] == 1 and out["bytes"] > 0 and out["codecs"]


def test_file_profile_of_empty_files(spark, tmp_path):
    spark.range(0, 8, numPartitions=4).where("id > 3").write.parquet(str(tmp_path / "t"))
    out = profiling.file_profile(spark, str(tmp_path / "t"))
    assert (out["files"], out["empty_files"], out["row_groups"], out["rows"]) == (3, 1, 2, 4)


def test_signature_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert layouts.signature(df.orderBy("x").collect()) == layouts.signature(df.select("y", "x").orderBy(F.desc("x")).collect())
    assert layouts.signature(df.collect()) != layouts.signature(df.limit(1).collect())


def test_contracts_as_json(tmp_path):
    contract = Contract("k", "t", "csv", (Field("A b", "string", "a_b"),), "data/x.csv", derive=(("n", "length(a_b)"),), rules=(Rule("r", "n > 3"),), unique=("a_b",), grain=Grain(("a_b",), (("c", "count(*)"),)))
    Registry((contract,)).save(tmp_path / "c.json")
    (back,) = load(tmp_path / "c.json").select("all")
    assert back == Contract(**(contract.__dict__ | {"path": str(tmp_path / "data/x.csv")}))
    with pytest.raises(KeyError, match="there are: k"):
        load(tmp_path / "c.json")["nope"]
    for bad in ({"format": "orc"}, {"fields": (Field("a", "int"), Field("b", "int", "a"))}, {"rules": (Rule("r", "true", "shout"),)}):
        with pytest.raises(ContractError):
            Contract(**({"key": "k", "logical_name": "k", "format": "csv", "fields": ()} | bad))
