import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from probegrid.operators import checks, consistency, grid, lineage, patterns, profiles, spatial
from probegrid.plans import catalog
from probegrid.sources.tables import default_point_config

T0 = dt.datetime(2024, 1, 1)
MATCHED = "block_id string, interval_30min timestamp_ntz, date date, tomtom_mean_ci_percent double, here_mean_jam_factor double"
CLEANED = (
    "point_id string, interval_15min timestamp_ntz, date date, current_speed double, free_flow_speed double, "
    "current_travel_time double, free_flow_travel_time double, ci_percent double, tti double, srr double, "
    "ett_seconds double, ci_formula_abs_error double, ci_negative_flag boolean"
)


def slot(i, minutes=30):
    return T0 + dt.timedelta(minutes=minutes * i)


def matched(spark, rows):
    return spark.createDataFrame([(b, slot(i), slot(i).date(), x, y) for b, i, x, y in rows], MATCHED)


def cleaned(spark, rows):
    """rows: point, 15-minute slot number, ci"""
    return spark.createDataFrame(
        [(p, slot(i, 15), slot(i, 15).date(), 50.0 + i, 60.0, 100.0 + c, 100.0, float(c), 1 + c / 100, 0.1, float(c), 0.0, c < 0) for p, i, c in rows],
        CLEANED,
    )


def test_block_mean_is_a_mean_of_point_means(spark):
    df = cleaned(spark, [("P01", 0, 10), ("P01", 1, 30), ("P02", 0, 80), ("P15", 0, 5)])
    rows = {r.block_id: r for r in grid.block_30min(df, default_point_config(spark)).collect()}
    assert rows["1"].tomtom_mean_ci_percent == 50.0 and rows["1"].tomtom_median_ci_percent == 50.0
    assert (rows["1"].tomtom_point_count, rows["1"].tomtom_record_count_15min) == (2, 3)
    assert rows["2"].tomtom_mean_ci_percent == 5.0


def test_point_without_block_fails(spark):
    df = cleaned(spark, [("P01", 0, 10), ("X", 0, 1), ("Y", 0, 1)])
    config = default_point_config(spark)
    assert [r.point_id for r in grid.unassigned_points(df, config).collect()] == ["X", "Y"]
    with pytest.raises(PySparkException, match="no block for point"):
        grid.block_30min(df, config).collect()


def test_point_configured_twice_fails(spark):
    config = spark.createDataFrame([("P01", "1"), ("P01", "2")], "point_id string, block_id string")
    with pytest.raises(PySparkException, match="configured twice"):
        grid.block_30min(cleaned(spark, [("P01", 0, 10)]), config).collect()


def test_numeric_ids_meet_text_ids(spark):
    config = spark.createDataFrame([(1.0, 3)], "point_id double, block_id int")
    row = grid.block_30min(cleaned(spark, [("1", 0, 10)]), config).first()
    assert row.block_id == "3"


def test_match_keeps_common_complete_slots(spark):
    a = spark.createDataFrame([("1", slot(0), 1.0), ("1", slot(1), None), ("2", slot(0), 3.0)], "block_id string, interval_30min timestamp_ntz, tomtom_mean_ci_percent double").withColumn("date", F.to_date("interval_30min"))
    b = spark.createDataFrame([(1, slot(0), 4.0), (1, slot(1), 5.0)], "block_id int, interval_30min timestamp_ntz, here_mean_jam_factor double").withColumn("date", F.to_date("interval_30min"))
    rows = grid.match_block_time(a, b).collect()
    assert [(r.block_id, r.interval_30min, r.date) for r in rows] == [("1", slot(0), T0.date())]
    assert "date_tomtom" in rows[0] and "date_here" in rows[0]


def test_tables_without_matches(spark):
    empty = matched(spark, [])
    summary = consistency.benchmark_summary(empty).collect()
    assert [(r.unit, r.matched_n, r.peak_overlap_index) for r in summary] == [("pooled", 0, None)]
    assert [r.matched_n for r in consistency.sensitivity_threshold(empty).collect()] == [0] * 4
    assert sorted((r.here_shift_minutes, r.matched_n) for r in consistency.sensitivity_lag(empty).collect()) == [(-30, 0), (0, 0), (30, 0)]
    assert consistency.sensitivity_per_block(empty).count() == consistency.sensitivity_daily(empty).count() == 0


def test_lag_moves_the_segment_side(spark):
    rows = [("1", i, float(v), float(w)) for i, (v, w) in enumerate(zip([1, 5, 2, 9, 4, 7], [5, 2, 9, 4, 7, 3]))]
    got = {r.here_shift_minutes: r for r in consistency.sensitivity_lag(matched(spark, rows)).collect()}
    assert {k: r.matched_n for k, r in got.items()} == {-30: 5, 0: 6, 30: 5}
    assert got[30].pearson_r == pytest.approx(1) and got[30].spearman_rho == pytest.approx(1)


def test_study_tables_agree_with_each_other(spark):
    rows = [(str(1 + i % 3), i, float((i * 37) % 101), float((i * 53) % 89)) for i in range(200)]
    df = matched(spark, rows)
    summary = {r.unit: r for r in consistency.benchmark_summary(df).collect()}
    pooled = summary.pop("pooled")
    assert sum(r.matched_n for r in summary.values()) == pooled.matched_n == 200
    assert 0 <= pooled.peak_overlap_index <= 1
    lag = consistency.sensitivity_lag(df).where("here_shift_minutes = 0").first()
    assert (lag.pearson_r, lag.peak_overlap_index) == (pytest.approx(pooled.pearson_r), pooled.peak_overlap_index)
    at85 = consistency.sensitivity_threshold(df).where("threshold_quantile = 0.85").first()
    assert at85.peak_overlap_index == pooled.peak_overlap_index
    for r in consistency.sensitivity_per_block(df).collect():
        assert r.spearman_rho == pytest.approx(summary[f"block_{r.block_id}"].spearman_rho)


def test_zscore_of_a_flat_profile_is_null(spark):
    df = cleaned(spark, [("P01", 0, 5), ("P01", 1, 5)])
    rows = profiles.with_zscores(profiles.intraday_profile(df)).collect()
    assert [r.z_ci_percent for r in rows] == [None, None]


def test_moving_average_counts_records_and_time(spark):
    df = cleaned(spark, [("P01", 0, 10), ("P01", 1, 20), ("P01", 10, 40)])
    rows = {r.interval_15min: r for r in profiles.moving_average(df).collect()}
    last = rows[slot(10, 15)]
    assert last.mean_last_records == pytest.approx(70 / 3) and last.mean_time_span == 40


def test_boxes_by_brute_force(spark):
    boxes = [("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.55, 0.15, 0.65, 0.95), ("c", -1.0, -1.0, 0.0, 0.0)]
    points = [(i, -0.95 + (i * 7 % 40) / 20, -0.95 + (i * 11 % 40) / 20) for i in range(200)]
    bdf = spark.createDataFrame([(n, f"{a},{b},{c},{d}") for n, a, b, c, d in boxes], "name string, bbox string")
    pdf = spark.createDataFrame(points, "id int, latitude double, longitude double")
    got = {(r.id, r.name) for r in spatial.points_in_boxes(pdf, bdf).collect()}
    want = {(i, n) for i, lat, lon in points for n, x0, y0, x1, y1 in boxes if x0 <= lon <= x1 and y0 <= lat <= y1}
    assert got == want and got


def test_geometry_keeps_flows_without_shapes(spark):
    flows = spark.createDataFrame([("f1", "k1"), ("f2", "k2")], "uuid string, bbox_uuid string")
    shapes = spark.createDataFrame([("k1", 2, 1.0, 2.0), ("k1", 1, 3.0, 4.0)], "flow_uuid string, sequence_order int, latitude double, longitude double")
    rows = {r.uuid: r.path for r in lineage.segment_geometry(flows, shapes).collect()}
    assert [p.sequence_order for p in rows["f1"]] == [1, 2] and rows["f2"] is None


@pytest.mark.parametrize("query", [catalog.segment_geometry, catalog.functional_class_compare])
def test_flows_meet_shapes_without_a_broadcast(spark, sf_dir, query):
    """Sizes known from the texts alone are far too small; documents are parsed before, once."""
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "from_json" not in plan


def test_a_flow_counts_once_per_class_also_for_an_unknown_one(spark):
    flows = spark.createDataFrame([("k1", 10.0, 1.0), ("k1", 20.0, 3.0), ("k2", 30.0, 2.0), ("k3", 99.0, 9.0)], "bbox_uuid string, speed_kmh double, jam_factor double")
    shapes = spark.createDataFrame([("k1", 1), ("k1", 1), ("k1", None), ("k1", None), ("k2", 1), ("gone", 5)], "flow_uuid string, functional_class int")
    got = {tuple(r) for r in patterns.functional_class_compare(flows, shapes).collect()}
    assert got == {(1, 3, 20.0, 2.0, 3.0), (None, 2, 15.0, 2.0, 3.0)}


def test_hotspots_and_checks(spark):
    df = cleaned(spark, [("P01", i, 100) for i in range(5)] + [("P02", i, i) for i in range(20)] + [("P03", 0, -5)])
    top = patterns.hotspots(df, k=2).collect()
    assert top[0].point_id == "P01" and top[0].high_share == 1.0 and len(top) == 2
    daily = spark.createDataFrame([(T0.date(), 5000)], "date date, observed_records long")
    got = {r.check: r.ok for r in checks.release_checks(df, daily, matched(spark, [("1", i, 1.0, 1.0) for i in range(3)])).collect()}
    assert got == {"max_daily_observed": False, "max_ci_formula_error": True, "negative_ci_share": True, "matched_pooled": True, "matched_block_1": True}


def test_calendar_comparison(spark):
    df = cleaned(spark, [("P01", 0, 10), ("P01", 1, 20), ("P01", 96, 40), ("P01", 97, 60)])
    calendar = spark.createDataFrame([(T0.date(), "normal"), (T0.date() + dt.timedelta(1), "affected")], "date date, label string")
    row = patterns.impact_comparison(df, calendar).first()
    assert (row.affected_mean, row.normal_mean, row.difference) == (50.0, 15.0, 35.0)
    assert row.welch_t == pytest.approx(35 / (200 / 2 + 50 / 2) ** 0.5)


def test_busy_block_slot(spark):
    """One block and slot with most records gives what the built-ins give."""
    rows = [("1", slot(0), float(1 + i * 37 % 61), float(i % 7), None if i % 5 else 0.5, None if i % 4 == 0 else f"S{i % 9}") for i in range(120)]
    rows += [("2", slot(i % 3), 10.0 + i, 1.0, None, "S1") for i in range(9)]
    df = spark.createDataFrame(rows, "block_id string, interval_30min timestamp_ntz, speed double, jam_factor double, confidence double, segment_id string")
    got = {(r.block_id, r.interval_30min): r for r in grid.segment_block_time(df).collect()}
    for key in {(r[0], r[1]) for r in rows}:
        part = [r for r in rows if (r[0], r[1]) == key]
        speeds = sorted(r[2] for r in part)
        mid = len(speeds) // 2
        median = speeds[mid] if len(speeds) % 2 else (speeds[mid - 1] + speeds[mid]) / 2
        row = got[key]
        assert row.here_median_speed == pytest.approx(median)
        assert row.here_record_count == len(part)
        assert row.here_segment_count == len({r[5] for r in part if r[5]})
    assert len(got) == 4
