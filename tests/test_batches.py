"""Tables fed by micro-batches are right after every batch, whatever the order and however often a batch runs."""

import datetime as dt
import pathlib

import pytest

from probegrid.operators import quality
from probegrid.plans import fixtures
from probegrid.sources import payloads
from probegrid.streaming import alerts, batches, feeds
from probegrid.streaming.runner import start_append

T0 = dt.datetime(2024, 1, 1)
VALID = "point_id string, interval_15min timestamp_ntz, date date"
BEATS = "job_name string, ts timestamp_ntz"


def at(m):
    return T0 + dt.timedelta(minutes=m)


class Landing:
    """A folder that files arrive in, and a stream of it that is started anew for every arrival."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.folder, self.ddl = spark, str(folder), ddl

    def land(self, rows):
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.ddl).parquet(self.folder)


def slot(p, m):
    t = at(m)
    return (p, t, t.date())


def test_availability_after_each_batch(spark, tmp_path):
    landing, out = Landing(spark, tmp_path / "in", VALID), str(tmp_path / "out")
    schema = quality.availability_of_counts(spark.createDataFrame([], "date date, observed_records bigint")).schema

    def run(rows):
        landing.land(rows)
        batches.start_availability(landing.stream(), out, str(tmp_path / "cp"), expected=4).awaitTermination()
        found = batches.read_availability(spark, out, schema).collect()
        return {r.date.day: (r.observed_records, r.availability_check_flag) for r in found}

    assert run([slot("a", 0), slot("a", 0), slot("b", 15)]) == {1: (2, "OK")}
    day = 24 * 60
    assert run([slot("a", 2 * day), slot("a", 15), (None, at(0), None)]) == {1: (3, "OK"), 3: (1, "OK")}
    # an earlier day last, slots seen before, and more than expected
    assert run([slot("a", 0), slot("b", 15), slot("a", day), slot("c", 0), slot("d", 0)]) == {1: (5, "CHECK_OBSERVED_GT_EXPECTED"), 2: (1, "OK"), 3: (1, "OK")}


def test_batch_that_runs_again_adds_nothing(spark, tmp_path):
    landing, out = Landing(spark, tmp_path / "in", VALID), str(tmp_path / "out")
    schema = quality.availability_of_counts(spark.createDataFrame([], "date date, observed_records bigint")).schema
    landing.land([slot("a", 0), slot("b", 15)])
    batches.start_availability(landing.stream(), out, str(tmp_path / "cp1")).awaitTermination()
    # a new checkpoint gives the same batch its id again, as after a failure before the commit
    batches.start_availability(landing.stream(), out, str(tmp_path / "cp2")).awaitTermination()
    assert batches.read_availability(spark, out, schema).first().observed_records == 2
    assert batches.read_batches(spark, f"{out}/slots", batches.SLOTS).count() == 2


DOCUMENT = '{"results": [{"location": {"description": "R", "shape": {"links": [{"points": [{"lat": 1, "lng": 2}]}]}}}]}'


def test_one_parse_three_tables(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = "batch_id string, place_id string, capture_time string, js string"
    schemas = payloads.parse_segment_payloads(spark.createDataFrame([], feeds.SEGMENT_ENVELOPE))

    def run(rows, checkpoint="cp"):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(folder)
        documents = feeds.segment_documents(spark, folder, maxFilesPerTrigger="1")
        batches.start_ingest(documents, payloads.parse_segment_payloads, out, str(tmp_path / checkpoint)).awaitTermination()
        return [batches.read_ingested(spark, out, n, getattr(schemas, n).schema).count() for n in ("flows", "shapes", "rejects")]

    assert run([("A", "p", "2024-01-01T00:00:00", DOCUMENT), ("B", "p", "2024-01-01T00:00:00", "[")]) == [1, 1, 1]
    assert run([("C", "p", "2024-01-01T00:00:00", "")]) == [1, 1, 2]
    assert run([("D", "q", "2024-01-01T00:00:00", DOCUMENT)]) == [2, 2, 2]
    commits = batches.read_commits(spark, out).orderBy("micro_batch").collect()
    assert [(r.flows, r.shapes, r.rejects) for r in commits] == [(1, 1, 1), (0, 0, 1), (1, 1, 0)]
    # what a batch wrote before its commit is not seen
    batches.put_batch(batches.read_ingested(spark, out, "flows", schemas.flows.schema), f"{out}/flows", 99)
    assert batches.read_ingested(spark, out, "flows", schemas.flows.schema).count() == 2


FLAGGED = "block_id string, timestamp timestamp_ntz, speed double, jam_factor double, confidence double, is_valid boolean"


def test_every_row_is_kept_late_or_undated(spark, tmp_path):
    landing, out = Landing(spark, tmp_path / "in", FLAGGED), str(tmp_path / "out")

    def run(rows):
        landing.land(rows)
        batches.start_segment_windows(landing.stream(), out, str(tmp_path / "cp")).awaitTermination()
        audit = batches.read_audit(spark, out).orderBy("micro_batch").collect()
        assert all(r.arrived == r.kept + r.late + r.undated for r in audit)
        return [(r.kept, r.late, r.undated) for r in audit]

    row = lambda m, v=10.0, ok=True: ("1", None if m is None else at(m), v, v, None, ok)
    assert run([row(0), row(70), row(None), row(5, ok=False)]) == [(3, 0, 1)]
    # 70 less 30 minutes is the limit now, whatever comes first in the batch
    assert run([row(200), row(39), row(40, 20.0)]) == [(3, 0, 1), (2, 1, 0)]
    assert run([row(None)]) == [(3, 0, 1), (2, 1, 0), (0, 0, 1)]
    windows = {r.interval_30min: (r.here_mean_speed, r.here_record_count, r.here_mean_confidence) for r in batches.read_segment_windows(spark, out).collect()}
    assert windows == {at(0): (10.0, 1, None), at(60): (10.0, 1, None), at(180): (10.0, 1, None), at(30): (20.0, 1, None)}
    aside = batches.read_aside(spark, out, spark.createDataFrame([], FLAGGED).schema)
    assert sorted((r.micro_batch, r.fate) for r in aside.collect()) == [(0, "undated"), (1, "late"), (2, "undated")]


def test_alert_while_a_job_is_silent(spark, tmp_path):
    landing, out = Landing(spark, tmp_path / "in", BEATS), str(tmp_path / "out")

    def run(rows, again=False):
        if rows:
            landing.land(rows)
        start_append(alerts.outage_events(landing.stream()), out, str(tmp_path / "cp")).awaitTermination()
        return sorted(((r.event, r.job_name, r.last_beat, r.at) for r in spark.read.parquet(out).collect()), key=str)

    assert run([("a", at(m)) for m in (10, 0, 5)] + [("b", at(m)) for m in (0, 10, 20)]) == []
    # a is silent in this batch; the time of b moves on
    raised = run([("b", at(m)) for m in (30, 40, 50, 60)])
    assert raised == [("alert", "a", at(10), at(25))]
    assert run([]) == raised
    ended = run([("a", at(61)), ("b", at(75)), ("a", at(76)), ("b", at(90)), ("b", at(105)), ("a", at(91)), ("a", at(106))])
    assert ended == sorted([*raised, ("recovery", "a", at(10), at(61))], key=str)
    events = spark.read.parquet(out)
    assert [(r.job_name, r.silent_seconds) for r in alerts.ended_outages(events).collect()] == [("a", 51 * 60.0)]
    assert alerts.open_outages(events).count() == 0


def test_stale_beats_and_ticks(spark, tmp_path):
    """A beat delivered a minute late proves nothing; a clock raises alerts when all jobs are silent."""
    seen = Landing(spark, tmp_path / "in", "job_name string, ts timestamp_ntz, seen timestamp_ntz")
    clock = Landing(spark, tmp_path / "clock", "ts timestamp_ntz")
    out = str(tmp_path / "out")
    seen.land([("a", at(0), at(0)), ("a", at(30), at(31)), ("a", at(40), at(40) + dt.timedelta(seconds=59))])
    clock.land([(at(200),)])
    stream = alerts.outage_events(seen.stream(), ticks=clock.stream(), seen="seen")
    start_append(stream, out, str(tmp_path / "cp")).awaitTermination()
    events = spark.read.parquet(out)
    assert sorted((r.event, r.last_beat, r.at) for r in events.collect()) == [("alert", at(0), at(15)), ("alert", at(40), at(55)), ("recovery", at(0), at(40))]
    assert [r.last_beat for r in alerts.open_outages(events).collect()] == [at(40)]


@pytest.mark.parametrize("spans, now, want", [
    ([(0, 5)], 15, ([(0, 5)], False, [])),
    ([(0, 5)], 16, ([(0, 5)], True, [("alert", 5, 15)])),
    ([(0, 5), (30, 31)], 16, ([(30, 31)], False, [("alert", 5, 15), ("recovery", 5, 30)])),
    ([(0, 5), (30, 31)], 99, ([(30, 31)], True, [("alert", 5, 15), ("recovery", 5, 30), ("alert", 31, 41)])),
])
def test_closing_spans(spans, now, want):
    assert alerts.close_spans(spans, False, now, 10) == want
    assert alerts.merged([(30, 31), (0, 5), (15, 16), (4, 9)], 6) == [(0, 16), (30, 31)]


def test_landed_documents_come_in_three_batches_of_many_files(spark, sf_dir, tmp_path):
    """A file for every core, so that landing is not the work of three tasks."""
    folder, out = fixtures.landed_segment_payloads(spark, sf_dir), str(tmp_path / "out")
    want = fixtures.segment_payload(spark, sf_dir).count()
    assert len(list(pathlib.Path(folder).glob("*.json"))) >= spark.sparkContext.defaultParallelism > fixtures.SHARES
    documents = feeds.segment_documents(spark, folder, maxFilesPerTrigger=str(fixtures.files_per_share(spark)))
    assert spark.read.json(folder).count() == want
    batches.start_ingest(documents, payloads.parse_segment_payloads, out, str(tmp_path / "cp")).awaitTermination()
    assert batches.read_commits(spark, out).count() == fixtures.SHARES
