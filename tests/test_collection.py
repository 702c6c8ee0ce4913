import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from probegrid.operators import operations
from probegrid.sources import payloads, tables
from probegrid.plans import fixtures

T0 = dt.datetime(2024, 1, 1)


def docs(spark, texts):
    return spark.createDataFrame([(f"A{i}", T0, t) for i, t in enumerate(texts)], "point_uuid string, capture_time timestamp_ntz, js string")


def seg_docs(spark, texts):
    return spark.createDataFrame([(f"B{i}", "x", T0, t) for i, t in enumerate(texts)], "batch_id string, place_id string, capture_time timestamp_ntz, js string")


def test_point_documents(spark):
    full = {"flowSegmentData": {"currentSpeed": "41", "freeFlowSpeed": 60.9, "confidence": 0.5, "roadClosure": True,
                                "coordinates": {"coordinate": [{"latitude": 1.0, "longitude": 2.0}, {"latitude": 3.0}]}}}
    bare = {"flowSegmentData": {"coordinates": {"coordinate": []}}}
    no_shape = {"flowSegmentData": {"currentSpeed": 5}}
    got = payloads.parse_point_payloads(docs(spark, [json.dumps(full), json.dumps(bare), json.dumps(no_shape), "{\"a\": 1}", "{oops", "", None]))
    flows = {r.point_uuid: r for r in got.flows.collect()}
    assert set(flows) == {"A0", "A1"}
    assert (flows["A0"].current_speed, flows["A0"].free_flow_speed, flows["A0"].current_travel_time, flows["A0"].road_closure) == (41, 60, 0, True)
    assert (flows["A1"].current_speed, flows["A1"].confidence, flows["A1"].road_closure) == (0, 0.0, False)
    shapes = got.shapes.orderBy("sequence_order").collect()
    assert [(s.flow_uuid, s.latitude, s.longitude, s.sequence_order) for s in shapes] == [(flows["A0"].uuid, 1.0, 2.0, 1), (flows["A0"].uuid, 3.0, 0.0, 2)]
    reasons = {r.point_uuid: r.reject_reason for r in got.rejects.collect()}
    assert reasons == {"A2": "no_coordinates", "A3": "no_flow_segment", "A4": "unparseable", "A5": "empty", "A6": "empty"}


def test_segment_documents(spark):
    link = lambda n, c, k: {"length": n, "functionalClass": c, "points": [{"lat": float(i), "lng": 9.0} for i in range(k)]}
    good = {"results": [
        {"location": {"description": "R1", "length": 70.4, "shape": {"links": [link(10, 1, 2), link(20, 2, 3)]}}, "currentFlow": {"speed": 12.5}},
        {"location": {"description": "R2", "shape": {"links": []}}},
    ]}
    half = {"results": [good["results"][0], {"currentFlow": {"speed": 1}}]}
    got = payloads.parse_segment_payloads(seg_docs(spark, [json.dumps(good), json.dumps(half), '{"results": []}', "[[", '{"x": 1}']))
    flows = {r.road_name: r for r in got.flows.collect()}
    assert set(flows) == {"R1", "R2"}
    assert (flows["R1"].number_roads, flows["R1"].speed_kmh, flows["R1"].jam_factor) == (2, 12.5, None)
    assert (flows["R2"].number_roads, flows["R2"].speed_kmh, flows["R2"].jam_factor) == (0, 0.0, 0.0)
    assert flows["R1"].uuid != flows["R1"].bbox_uuid
    shapes = got.shapes.orderBy("sequence_order").collect()
    assert [(s.sequence_order, s.zl_length, s.functional_class, s.all_length) for s in shapes] == [(1, 10, 1, 70), (2, 10, 1, 70), (3, 20, 2, 70), (4, 20, 2, 70), (5, 20, 2, 70)]
    assert {s.flow_uuid for s in shapes} == {flows["R1"].bbox_uuid}
    assert {r.batch_id: r.reject_reason for r in got.rejects.collect()} == {"B1": "incomplete_result", "B2": "no_results", "B3": "unparseable", "B4": "no_results"}


def test_ids_repeat(spark):
    text = '{"flowSegmentData": {"coordinates": {"coordinate": []}}}'
    first, second = (payloads.parse_point_payloads(docs(spark, [text])).flows.first().uuid for _ in range(2))
    assert first == second


def test_round_robin(spark, sf_dir):
    points, keys = fixtures.monitor_points(spark, sf_dir), fixtures.api_keys(spark, sf_dir)
    rows = operations.round_robin_assign(points, keys, "r1", seed=3).collect()
    total = points.count()
    assert len(rows) == total * 20 // 25 and len({r.point_uuid for r in rows}) == len(rows)
    again = operations.round_robin_assign(points, keys, "r1", seed=3).collect()
    other = operations.round_robin_assign(points, keys, "r1", seed=4).collect()
    pairs = lambda rs: {(r.key_number, r.point_uuid) for r in rs}
    assert pairs(rows) == pairs(again) != pairs(other)
    sizes = {}
    for r in rows:
        sizes[r.key_number] = sizes.get(r.key_number, 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert len(operations.round_robin_assign(points, keys, "r1", filter_first=True).collect()) == total
    with pytest.raises(ValueError, match="no rows"):
        operations.round_robin_assign(points, keys.where("false"), "r1")


def test_heartbeats(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    beats = [("a", at(m)) for m in (0, 1, 16, 31.001, 90)] + [("b", at(m)) for m in (0, 14, 29)] + [("c", None)]
    df = spark.createDataFrame(beats, "job_name string, ts timestamp_ntz")
    got = sorted(tuple(r)[:4] for r in operations.heartbeat_outages(df).collect())
    assert got == [("a", at(16), at(31), at(31.001)), ("a", at(31.001), at(46.001), at(90))]


def test_latest_failure_and_state(spark):
    rows = [("u1", "j", T0, T0 + dt.timedelta(hours=1), "FAILED"), ("u2", "j", T0, T0 + dt.timedelta(hours=2), "SUCCESS"), ("u3", "j", T0, None, "RUNNING")]
    df = spark.createDataFrame(rows, "uuid string, job_name string, start_time timestamp_ntz, end_time timestamp_ntz, status string")
    assert operations.latest_failed_job(df).first().uuid == "u1"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("P01", None, "2024-01-01"), ("NA", "1.5", "2024-01-02")], "point_id string, tti string, date string")
    tables.write_csv(df, str(tmp_path / "a" / "b.csv"))
    back = tables.read_table(spark, str(tmp_path / "a" / "b.csv"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("P01", None, "2024-01-01"), (None, "1.5", "2024-01-02")], key=str)
    tables.write_table(df, str(tmp_path / "c.parquet"), ["date"])
    assert sorted(p.name for p in (tmp_path / "c.parquet").iterdir() if p.is_dir()) == ["date=2024-01-01", "date=2024-01-02"]
    assert tables.read_table(spark, str(tmp_path / "c.parquet")).count() == 2
    with pytest.raises(ValueError, match="use .csv or .parquet"):
        tables.read_table(spark, "x.xlsx")
    spark.createDataFrame([("tti", "ratio"), ("other", "x")], "variable string, unit string").write.option("header", True).csv(str(tmp_path / "d.csv"))
    dictionary = tables.read_dictionary(spark, str(tmp_path / "d.csv"))
    described = {r.variable: r.description for r in tables.describe_outputs(tables.with_dictionary(df, dictionary)).collect()}
    assert described == {"point_id": None, "tti": "unit: ratio", "date": None}


def test_dimensions(spark, tmp_path):
    spark.createDataFrame([("P01", 2)], "point_id string, block_id int").write.parquet(str(tmp_path / "cfg.parquet"))
    row = tables.read_point_config(spark, str(tmp_path / "cfg.parquet")).first()
    assert (row.point_id, row.block_id, row.corridor_order) == ("P01", "2", None)
    spark.createDataFrame([], "uuid string, name string, bbox string").write.parquet(str(tmp_path / "box.parquet"))
    from probegrid.schema import MONITOR_BOX
    with pytest.raises(ValueError, match="no rows"):
        tables.read_dimension(spark, str(tmp_path / "box.parquet"), MONITOR_BOX, "boxes")
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_dimension(spark, str(tmp_path / "cfg.parquet"), MONITOR_BOX, "boxes")
    assert tables.default_point_config(spark).where("block_id = '3'").count() == 14


def test_numbers_that_cannot_be_stored(spark):
    texts = ["12", " 12.7 ", "", "  ", None, "x", "NaN", "99999999999", "-Infinity", "1e400"]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select(
        payloads._unread(F.col("c")).alias("whole"), payloads._unread(F.col("c"), payloads._double).alias("double")).collect()
    assert [t for t, r in zip(texts, rows, strict=True) if r.whole] == ["x", "NaN", "99999999999", "-Infinity", "1e400"]
    assert [t for t, r in zip(texts, rows, strict=True) if r.double] == ["x", "NaN"]
