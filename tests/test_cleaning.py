import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probegrid.functions.scalars import (
    day_type, floor_minutes, from_event_time, as_event_time, id_text, is_closed, parse_number, parse_timestamp,
)
from probegrid.operators import quality
from probegrid.operators.normalize import normalize_columns, standardize_points, standardize_segments
from probegrid.schema import EXPECTED_PER_DAY, POINT_ALIASES

POINT_DDL = (
    "point_id string, timestamp string, current_speed double, free_flow_speed double, "
    "current_travel_time double, free_flow_travel_time double, confidence double, road_closure string, ingest_seq long"
)


def point(pid="P01", ts="2024-01-01 00:03:00", v=50.0, v0=60.0, t=110.0, t0=100.0, conf=0.9, closed=None, seq=0):
    return (pid, ts, v, v0, t, t0, conf, closed, seq)


def test_expected_per_day():
    assert EXPECTED_PER_DAY == 4032


def test_alias_rules(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], " `Site-ID` int, time int, timestamp int, other int")
    assert normalize_columns(df, POINT_ALIASES).columns == ["point_id", "time", "timestamp", "other"]
    twice = spark.createDataFrame([(1, 2)], "`v cur` int, `v-cur` int")
    assert normalize_columns(twice, POINT_ALIASES).columns == ["v cur", "current_speed"]
    clash = spark.createDataFrame([(1, 2)], "`conf` int, `Confidence ` int")
    assert normalize_columns(clash, POINT_ALIASES).columns == ["conf", "confidence"]


def test_rename_to_an_existing_name_fails(spark):
    df = spark.createDataFrame([(1, 2)], "`point_id` int, `POINT ID` int")
    with pytest.raises(ValueError, match="two columns"):
        normalize_columns(df, POINT_ALIASES)


def test_missing_columns_fail_before_any_job(spark):
    df = spark.createDataFrame([("P01", "x")], "point_id string, timestamp string")
    with pytest.raises(ValueError, match="current_speed"):
        standardize_points(df)


def test_optional_columns_are_made(spark):
    df = spark.createDataFrame([("1", "2024-01-01 00:31:00", 3.0, 1.0)], "block string, time string, speed double, jf double")
    row = standardize_segments(df).first()
    assert row.confidence is None and row.segment_id is not None
    assert row.interval_30min == dt.datetime(2024, 1, 1, 0, 30)
    raw = spark.createDataFrame([point()[:6]], ", ".join(POINT_DDL.split(", ")[:6]))
    flagged = quality.clean_points(raw).flagged.first()
    assert flagged.is_valid_base and not flagged.confidence_exists and flagged.ingest_seq is not None


def test_number_text(spark):
    cases = {"12": 12.0, " 1.5 ": 1.5, "-3e2": -300.0, "12f": None, "12d": None, "NaN": None, "x": None, "": None, ".5": 0.5, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse_number(F.col("s"), T.StringType()).alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(parse_number(F.col("x"), T.DoubleType()))
    assert nan.first()[0] is None


def test_time_text(spark):
    at = dt.datetime(2024, 3, 5, 7, 8, 9)
    cases = {
        "2024-03-05 07:08:09": at, "2024-03-05T07:08:09": at, " 2024/03/05 07:08:09 ": at, "03/05/2024 07:08:09": at,
        "05-Mar-2024 07:08:09": at, "not-a-time": None, "2024-13-01 00:00:00": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse_timestamp(F.col("s"), T.StringType()).alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases


def test_floor_and_event_time(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 1, 1, 0, 15), dt.datetime(2024, 1, 1, 0, 29, 59, 1), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    rows = df.select(floor_minutes(F.col("t"), 15).alias("a"), from_event_time(as_event_time(F.col("t"))).alias("b")).collect()
    assert [r.a for r in rows] == [dt.datetime(1969, 12, 31, 23, 45), dt.datetime(2024, 1, 1, 0, 15), dt.datetime(2024, 1, 1, 0, 15), None]
    assert [r.b for r in rows] == times
    with pytest.raises(ValueError):
        floor_minutes(F.col("t"), 7)


def test_small_rules(spark):
    df = spark.createDataFrame([(" Closed ", 1.0, "7.0"), (None, 2.5, "07"), ("open", None, "P1")], "c string, x double, s string")
    rows = df.select(is_closed(F.col("c")), id_text(F.col("x"), T.DoubleType()), id_text(F.col("s"), T.StringType())).collect()
    assert [tuple(r) for r in rows] == [(True, "1", "7"), (False, "2.5", "07"), (False, None, "P1")]
    days = spark.createDataFrame([(dt.datetime(2024, 1, 5),), (dt.datetime(2024, 1, 6),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in days.select(day_type(F.col("t"))).collect()] == ["weekday", "weekend", None]
    flags = spark.createDataFrame([(True, 1)], "b boolean, i int").select(is_closed(F.col("b")), is_closed(F.col("i"))).first()
    assert tuple(flags) == (True, True)


def test_cleaning_rules(spark):
    rows = [
        point(seq=1, ts="2024-01-01 00:05:00"), point(seq=2, ts="2024-01-01 00:03:00"), point(seq=3, ts="2024-01-01 00:03:00"),
        point("P02", ts="bad"), point("P02", v=None), point("P02", v=0.0), point("P02", t0=-1.0), point("P02", closed=" YES "),
        point("P03", conf=None, t=90.0), point(None), point("P04", ts="2024-01-02 00:00:00", v=float("nan")),
    ]
    tables = quality.clean_points(spark.createDataFrame(rows, POINT_DDL))
    kept = {(r.point_id, r.ingest_seq) for r in tables.cleaned.collect()}
    assert kept == {("P01", 2), ("P03", 0)}
    assert {r.ingest_seq for r in tables.duplicate_log.collect()} == {1, 3}
    log = {r.date: r for r in tables.cleaning_log.collect()}
    first = log[dt.date(2024, 1, 1)]
    assert (first.raw_records, first.missing_core_field_records, first.non_positive_speed_records) == (9, 2, 2)
    assert (first.non_positive_travel_time_records, first.closure_related_records, first.confidence_missing_records) == (1, 1, 1)
    assert (first.duplicate_records, first.valid_records) == (2, 2)
    assert log[None].raw_records == 1 and log[None].valid_records == 0 and log[None].invalid_time_records == 1
    assert log[dt.date(2024, 1, 2)].non_positive_speed_records == 1
    day = tables.daily_availability.collect()
    assert [(r.date, r.observed_records, r.availability_check_flag) for r in day] == [(dt.date(2024, 1, 1), 2, "OK")]
    assert day[0].availability_rate + day[0].missing_rate == pytest.approx(1)
    p3 = tables.cleaned.where("point_id = 'P03'").first()
    assert p3.ci_negative_flag and p3.ci_percent == pytest.approx(-10) and p3.tti == pytest.approx(1 + p3.ci_percent / 100)
    strict = quality.clean_points(spark.createDataFrame(rows, POINT_DDL), require_confidence=True).cleaned
    assert {r.point_id for r in strict.collect()} == {"P01"}
    over = quality.daily_availability(tables.cleaned, expected=1).first()
    assert over.availability_check_flag == "CHECK_OBSERVED_GT_EXPECTED"


def test_empty_feed(spark):
    tables = quality.clean_points(spark.createDataFrame([], POINT_DDL))
    assert tables.cleaned.count() == tables.cleaning_log.count() == tables.daily_availability.count() == 0


def test_date_range_reaches_the_scan(spark, tmp_path):
    typed = spark.createDataFrame([point()], POINT_DDL).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    typed.write.parquet(str(tmp_path / "p"))
    raw = spark.read.parquet(str(tmp_path / "p"))
    plan = quality.clean_points(raw, date_from="2024-01-01", date_to="2024-02-01").cleaned._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed


def test_dedup_limits_each_map_task(spark, sf_dir):
    from probegrid.plans import fixtures

    plan = quality.clean_points(fixtures.point_raw(spark, sf_dir)).kept._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


@pytest.mark.parametrize("seqs", [[None] * 6, [1] * 6, [1, 1, 2, None, 3, 3]])
def test_kept_and_removed_are_all(spark, seqs):
    """Whatever the sequence number is, each valid record is either kept or listed as removed."""
    from probegrid.operators.dedup import duplicates_of, keep_first

    rows = [("P1", "2024-01-01 00:00:00", "2024-01-01 00:00:00", s, v) for s, v in zip(seqs, [1.0, 1.0, 2.0, None, 1.0, 3.0])]
    df = spark.createDataFrame(rows, "point_id string, timestamp string, interval_15min string, ingest_seq long, x double")
    kept = keep_first(df)
    removed = duplicates_of(df, kept)
    assert kept.count() == 1 and removed.columns == df.columns
    assert sorted(map(str, kept.union(removed).collect())) == sorted(map(str, df.collect()))


def test_white_space_and_offsets(spark):
    df = spark.createDataFrame([("Closed\t", "\n12.5\u00a0", "2024-01-01T08:00:00+08:00"), ("open", "x", "2024-01-01T00:00:00Z"), ("", "", " 2024-01-01 00:00:00\t")], "a string, b string, c string")
    got = df.select(is_closed(F.col("a")).alias("a"), parse_number(F.col("b"), T.StringType()).alias("b"), parse_timestamp(F.col("c"), T.StringType()).cast("string").alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, 12.5, "2024-01-01 00:00:00"), (False, None, "2024-01-01 00:00:00"), (False, None, "2024-01-01 00:00:00")]
