"""Collection bookkeeping: assignments, key usage, jobs, heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probegrid.functions.order_stats import row_numbers
from probegrid.functions.scalars import epoch_micros, interval_seconds, ratio
from probegrid.schema import OUTAGE_MINUTES
from probegrid.sources.tables import require_rows


# --- Assignment of points to keys -------------------------------------------

def _deal(points: DataFrame, keys: DataFrame, platform: str, filter_first: bool, run_id: str,
          order: list[str]) -> DataFrame:
    if filter_first:
        keys = keys.where(F.col("platform") == platform)
    # The key table is one row per account: a single ordered window is fine.
    seats = keys.select(
        F.col("uuid").alias("key_number"),
        "platform",
        (F.row_number().over(Window.orderBy("uuid")) - 1).cast("bigint").alias("seat"),
    )
    n_keys = keys.agg(F.count("*")).scalar()
    return (
        row_numbers(points, order, "turn")
        .withColumn("seat", (F.col("turn") - 1) % n_keys)
        .join(seats, "seat")
        .where(F.col("platform") == platform)
        .select(
            F.md5(F.concat_ws("#", F.lit(run_id), F.col("uuid"))).alias("uuid"),
            F.lit(run_id).alias("pd_uuid"),
            "key_number",
            F.col("uuid").alias("point_uuid"),
            "latitude",
            "longitude",
        )
    )


def round_robin_assign(
    points: DataFrame, keys: DataFrame, run_id: str, seed: int = 0, platform: str = "TOMTOM", filter_first: bool = False
) -> DataFrame:
    """Deal the points over all keys in a shuffled order; keep one platform.

    Points dealt to another platform's key are dropped from the run, unless
    ``filter_first`` deals over the wanted platform's keys only. The order is
    a seeded hash of the id, so a run can be repeated.
    """
    require_rows(keys, "api keys")
    require_rows(points, "monitor points")
    mixed = points.withColumn("_mix", F.md5(F.concat_ws("#", F.col("uuid"), F.lit(str(seed)))))
    return _deal(mixed, keys, platform, filter_first, run_id, ["_mix", "uuid"])


def ordered_assign(
    points: DataFrame, keys: DataFrame, run_id: str, order: str, platform: str = "TOMTOM", filter_first: bool = False
) -> DataFrame:
    """As ``round_robin_assign``, in the order of a number column."""
    require_rows(keys, "api keys")
    require_rows(points, "monitor points")
    return _deal(points, keys, platform, filter_first, run_id, [order, "uuid"])


def assignment_balance(assignments: DataFrame, planned: int | None = None) -> DataFrame:
    """Points per run and key: how many, how evenly, how many were lost."""
    per_key = assignments.groupBy("pd_uuid", "key_number").agg(F.count("*").alias("n"))
    runs = per_key.groupBy("pd_uuid").agg(
        F.sum("n").alias("assigned_points"),
        F.count("*").alias("used_keys"),
        F.min("n").alias("min_per_key"),
        F.max("n").alias("max_per_key"),
    )
    if planned is None:
        return runs
    return runs.withColumn("lost_points", F.lit(planned) - F.col("assigned_points"))


def run_completeness(assignments: DataFrame, flows: DataFrame) -> DataFrame:
    """Planned and captured points per run; a run stops at its first failure."""
    # a point may have several flows: it is captured once
    seen = flows.select(F.col("point_uuid").alias("uuid")).distinct().withColumn("captured", F.lit(True))
    return assignments.select("uuid", "pd_uuid").join(seen, "uuid", "left").groupBy("pd_uuid").agg(
        F.count("*").alias("planned_points"),
        F.count("captured").alias("captured_points"),
        F.count_if(F.col("captured").isNull()).alias("missing_points"),
        ratio(F.count("captured"), F.count("*").cast("double")).alias("captured_share"),
    )


# --- Keys --------------------------------------------------------------------

def key_usage_daily(runs: DataFrame) -> DataFrame:
    """One request per key and run, one error more where the run failed."""
    return runs.groupBy("api_key_uuid", F.to_date("run_time").alias("usage_date")).agg(
        F.count("*").alias("request_count"), F.count_if(F.col("failed")).alias("error_count")
    )


def key_usage_dense(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """A row for every key and day of the usage period, zeros included."""
    period = usage.agg(F.min("usage_date").alias("first"), F.max("usage_date").alias("last"))
    days = F.explode(F.sequence(period.select("first").scalar(), period.select("last").scalar()))
    grid = keys.select(F.col("uuid").alias("api_key_uuid")).withColumn("usage_date", days)
    return grid.join(usage, ["api_key_uuid", "usage_date"], "left").select(
        "api_key_uuid",
        "usage_date",
        F.coalesce("request_count", F.lit(0)).alias("request_count"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
    )


def key_quota_use(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """Daily and month-to-date use against the limits of each key.

    The running sum covers one key and month, 31 rows at most.
    """
    month = F.date_trunc("month", "usage_date").cast("date")
    to_date = Window.partitionBy("api_key_uuid", "usage_month").orderBy("usage_date")
    used = usage.withColumn("usage_month", month).withColumn("month_requests", F.sum("request_count").over(to_date))
    limits = keys.select(F.col("uuid").alias("api_key_uuid"), "daily_limit", "monthly_limit")
    return used.join(limits, "api_key_uuid").select(
        "api_key_uuid",
        "usage_date",
        "request_count",
        "month_requests",
        ratio(F.col("request_count").cast("double"), F.col("daily_limit").cast("double")).alias("daily_use"),
        ratio(F.col("month_requests").cast("double"), F.col("monthly_limit").cast("double")).alias("monthly_use"),
        ((F.col("request_count") > F.col("daily_limit")) | (F.col("month_requests") > F.col("monthly_limit"))).alias(
            "over_limit"
        ),
    )


# --- Jobs ---------------------------------------------------------------------

def latest_failed_job(logs: DataFrame) -> DataFrame:
    """The failed job that ended last."""
    return logs.where("status = 'FAILED'").orderBy(F.desc("end_time"), "uuid").limit(1)


def current_job_state(changes: DataFrame) -> DataFrame:
    """The last state of each job from its change rows."""
    state = ["job_name", "start_time", "end_time", "status", "total_points", "success_points"]
    newest = F.max_by(F.struct(*state), F.struct("changed_at", (F.col("status") != "RUNNING")))
    return changes.groupBy("uuid").agg(newest.alias("s")).select("uuid", "s.*")


def job_run_summary(logs: DataFrame) -> DataFrame:
    """Runs, outcomes, duration and success ratio per job and start date."""
    seconds = interval_seconds(F.col("end_time") - F.col("start_time")).cast("double")
    return logs.groupBy("job_name", F.to_date("start_time").alias("date")).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "RUNNING").alias("still_running"),
        F.avg(seconds).alias("mean_seconds"),
        F.sum("total_points").alias("total_points"),
        F.sum("success_points").alias("success_points"),
        ratio(F.sum("success_points").cast("double"), F.sum("total_points").cast("double")).alias("success_ratio"),
    )


# --- Heartbeats ----------------------------------------------------------------

def heartbeat_outages(beats: DataFrame, minutes: int = OUTAGE_MINUTES) -> DataFrame:
    """Silences longer than ``minutes`` per job, with alert and recovery time.

    Beats are first reduced to the first and last of each ``minutes``-wide
    bucket: no outage fits inside one. That step combines before the shuffle,
    and what is compared in order is one row per bucket and not one per beat.
    """
    width = minutes * 60 * 1_000_000
    micros = epoch_micros(F.col("ts"))
    buckets = (
        beats.where("ts is not null")
        .groupBy("job_name", F.floor(micros / width).alias("bucket"))
        .agg(F.min("ts").alias("first_beat"), F.max("ts").alias("last_beat"))
    )
    order = Window.partitionBy("job_name").orderBy("bucket")
    silent = buckets.select("job_name", F.lag("last_beat").over(order).alias("last_beat"), F.col("first_beat").alias("recovered_at"))
    threshold = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))
    return silent.where(F.col("recovered_at") > F.col("last_beat") + threshold).select(
        "job_name",
        "last_beat",
        (F.col("last_beat") + threshold).alias("alert_at"),
        "recovered_at",
        interval_seconds(F.col("recovered_at") - F.col("last_beat")).cast("double").alias("silent_seconds"),
    )
