import datetime as dt

from probegrid.operators import quality
from probegrid.streaming import feeds
from probegrid.streaming.runner import run_to_table, start_append

T0 = dt.datetime(2024, 1, 1)
END = dt.datetime(2100, 1, 1)
DDL = "point_id string, interval_15min timestamp_ntz, timestamp timestamp_ntz, ingest_seq long"


def at(m):
    return T0 + dt.timedelta(minutes=m)


def record(p, m, seq):
    t = at(m)
    return (p, t - dt.timedelta(minutes=t.minute % 15), t, seq)


def write(spark, rows, ddl, folder, mode="append"):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode(mode).parquet(folder)


def test_dedup_is_exact_for_unordered_arrival(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, [record("a", 5, 2), record("a", 3, 9), record("a", 3, 4), record("b", 1, 1), ("z", END, END, 0)], DDL, folder)
    stream = spark.readStream.schema(DDL).parquet(folder)
    got = run_to_table(feeds.dedup_stream(stream), "t").collect()
    assert {(r.point_id, r.ingest_seq) for r in got} == {("a", 4), ("b", 1)}


def test_restart_adds_no_row_twice(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write(spark, [record("a", 3, 1), record("b", 70, 2)], DDL, folder)

    def run():
        start_append(feeds.dedup_stream(spark.readStream.schema(DDL).parquet(folder)), out, cp).awaitTermination()
        return sorted(r.ingest_seq for r in spark.read.parquet(out).collect())

    assert run() == [1]
    assert run() == [1]
    write(spark, [("z", END, END, 0)], DDL, folder)
    assert run() == [1, 2]


def test_fast_dedup_keeps_one_per_slot(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, [record("a", 5, 2), record("a", 3, 9), record("b", 1, 1)], DDL, folder)
    got = run_to_table(feeds.dedup_stream_by_arrival(spark.readStream.schema(DDL).parquet(folder)), "t")
    assert got.groupBy("point_id").count().where("count > 1").isEmpty() and got.count() == 2


def test_alert_without_a_later_beat(spark, tmp_path):
    folder = str(tmp_path / "in")
    beats = [("a", at(m)) for m in (0, 10, 25, 60)] + [("b", at(5)), ("other", END)]
    write(spark, beats, "job_name string, ts timestamp_ntz", folder)
    stream = spark.readStream.schema("job_name string, ts timestamp_ntz").parquet(folder)
    sessions = run_to_table(feeds.heartbeat_sessions(stream), "t")
    alerts = {(r.job_name, r.last_beat, r.alert_at) for r in sessions.collect()}
    assert alerts == {("a", at(25), at(40)), ("a", at(60), at(75)), ("b", at(5), at(20))}
    assert [(r.job_name, r.recovered_at) for r in feeds.outages_of(sessions).collect()] == [("a", at(60))]


def test_point_windows(spark, tmp_path):
    ddl = "point_id string, interval_15min timestamp_ntz, current_speed double, ci_percent double"
    folder = str(tmp_path / "in")
    write(spark, [("a", at(0), 10.0, 1.0), ("a", at(15), 20.0, 3.0), ("a", at(30), 5.0, 5.0), ("z", END, 0.0, 0.0)], ddl, folder)
    got = run_to_table(feeds.point_windows(spark.readStream.schema(ddl).parquet(folder)), "t").orderBy("interval_start").collect()
    assert [(r.interval_start, r.mean_current_speed, r.record_count) for r in got] == [(at(0), 15.0, 2), (at(30), 5.0, 1)]


def test_segment_documents(spark, tmp_path):
    folder = str(tmp_path / "in")
    text = '{"results": [{"location": {"description": "R", "shape": {"links": []}}}]}'
    spark.createDataFrame([("B", "p", "2024-01-01T00:00:00.000001", text), ("C", "p", "2024-01-01T00:00:00", "[")], "batch_id string, place_id string, capture_time string, js string").write.json(folder)
    got = feeds.segment_ingest(spark, folder)
    flow = run_to_table(got.flows, "t").first()
    assert flow.road_name == "R" and flow.capture_time == dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    assert run_to_table(got.rejects, "t").first().batch_id == "C"
