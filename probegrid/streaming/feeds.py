"""Structured Streaming forms of the batch operators.

Every function takes and returns a streaming DataFrame; nothing is started
here. Rows later than the watermark delay are dropped by Spark: choose the
delay from how late collectors may deliver. Window aggregates give means and
counts only, since an exact median would keep all rows of a window as state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probegrid.functions.scalars import as_event_time, from_event_time
from probegrid.operators.dedup import SLOT_KEY
from probegrid.schema import ENVELOPE_TIME, EXPECTED_PER_DAY, OUTAGE_MINUTES
from probegrid.sources.payloads import Ingested, parse_point_payloads, parse_segment_payloads

DELAY = "30 minutes"

POINT_ENVELOPE = "point_uuid string, capture_time timestamp_ntz, js string"
SEGMENT_ENVELOPE = "batch_id string, place_id string, capture_time timestamp_ntz, js string"


def _landed(spark: SparkSession, folder: str, envelope: str, options: dict) -> DataFrame:
    reader = spark.readStream.option("timestampNTZFormat", ENVELOPE_TIME).options(**options)
    return reader.schema(envelope).json(folder)


def point_documents(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Landed point documents, unparsed."""
    return _landed(spark, folder, POINT_ENVELOPE, options)


def segment_documents(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Landed segment documents, unparsed."""
    return _landed(spark, folder, SEGMENT_ENVELOPE, options)


def point_ingest(spark: SparkSession, folder: str, **options) -> Ingested:
    """Flows, shapes and rejects from landed point documents."""
    return parse_point_payloads(point_documents(spark, folder, **options))


def segment_ingest(spark: SparkSession, folder: str, **options) -> Ingested:
    """Flows, shapes and rejects from landed segment documents."""
    return parse_segment_payloads(segment_documents(spark, folder, **options))


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", as_event_time(F.col(ts))).withWatermark("event_time", delay)


def dedup_stream(valid: DataFrame, delay: str = DELAY) -> DataFrame:
    """The earliest valid record per point and slot, once its slot is closed.

    Exact whatever the arrival order. ``slot_time`` is the event time for
    further windows.
    """
    record = F.struct(*valid.columns)
    first = F.min_by(record, F.struct("timestamp", "ingest_seq"))
    return (
        _timed(valid, "timestamp", delay)
        .groupBy("point_id", F.window("event_time", "15 minutes").alias("slot"))
        .agg(first.alias("record"))
        .select("record.*", F.window_time("slot").alias("slot_time"))
    )


def dedup_stream_by_arrival(valid: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first record to arrive per point and slot, given out at once.

    Keeps only the key as state; differs from ``dedup_stream`` where records
    of one slot arrive out of order.
    """
    return _timed(valid, "timestamp", delay).dropDuplicatesWithinWatermark(SLOT_KEY).drop("event_time")


def segment_windows(valid: DataFrame, width: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Means and counts of segment records per block and window."""
    return (
        _timed(valid, "timestamp", delay)
        .groupBy("block_id", F.window("event_time", width).alias("w"))
        .agg(
            F.avg("speed").alias("here_mean_speed"),
            F.avg("jam_factor").alias("here_mean_jam_factor"),
            F.count("*").alias("here_record_count"),
            F.avg("confidence").alias("here_mean_confidence"),
        )
        .withColumn("interval_30min" if width == "30 minutes" else "interval_start", from_event_time(F.col("w.start")))
        .drop("w")
    )


def point_windows(cleaned: DataFrame, width: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Means of point indicators per point and window."""
    return (
        _timed(cleaned, "interval_15min", delay)
        .groupBy("point_id", F.window("event_time", width).alias("w"))
        .agg(
            F.avg("current_speed").alias("mean_current_speed"),
            F.avg("ci_percent").alias("mean_ci_percent"),
            F.count("*").alias("record_count"),
        )
        .withColumn("interval_start", from_event_time(F.col("w.start")))
        .drop("w")
    )


def availability_stream(valid: DataFrame, expected: int = EXPECTED_PER_DAY, delay: str = DELAY) -> DataFrame:
    """Observed records per day: deduplicated slots, counted by day."""
    rate = F.col("observed_records") / F.lit(expected)
    return (
        dedup_stream(valid, delay)
        .groupBy(F.window("slot_time", "1 day").alias("day"))
        .agg(F.count("*").alias("observed_records"))
        .select(
            F.to_date(from_event_time(F.col("day.start"))).alias("date"),
            "observed_records",
            F.lit(expected).cast("bigint").alias("expected_records"),
            rate.alias("availability_rate"),
            (F.lit(expected) - F.col("observed_records")).alias("missing_records"),
            (1 - rate).alias("missing_rate"),
            F.when(F.col("observed_records") <= expected, "OK")
            .otherwise("CHECK_OBSERVED_GT_EXPECTED")
            .alias("availability_check_flag"),
        )
    )


def heartbeat_sessions(beats: DataFrame, minutes: int = OUTAGE_MINUTES, delay: str = DELAY) -> DataFrame:
    """Spans without a silence above ``minutes``, per job.

    A span is given out when the watermark passes its end, ``minutes`` after
    its last beat: that row is the alert, no later beat of the job is needed.
    """
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))
    return (
        _timed(beats, "ts", delay)
        .groupBy("job_name", F.session_window("event_time", f"{minutes} minutes").alias("s"))
        .agg(F.count("*").alias("beats"))
        .select(
            "job_name",
            from_event_time(F.col("s.start")).alias("first_beat"),
            (from_event_time(F.col("s.end")) - gap).alias("last_beat"),
            from_event_time(F.col("s.end")).alias("alert_at"),
            "beats",
        )
    )


def outages_of(sessions: DataFrame) -> DataFrame:
    """Outages that have ended, from the table of closed sessions.

    A job has at most one session per ``minutes``, so its window partition is
    bounded by the calendar.
    """
    order = Window.partitionBy("job_name").orderBy("first_beat")
    return sessions.select(
        "job_name", "last_beat", "alert_at", F.lead("first_beat").over(order).alias("recovered_at")
    ).where("recovered_at is not null")
