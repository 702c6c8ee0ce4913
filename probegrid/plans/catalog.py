"""Every registered query: operators applied to the derived feeds.

Doubles are rounded to six places here, and only here, so that two engines'
summation orders do not show in a comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probegrid.functions import scalars
from probegrid.functions.indicators import with_indicators
from probegrid.functions.order_stats import percentiles, pooled
from probegrid.operators import consistency, grid, lineage, operations, patterns, profiles, quality, spatial
from probegrid.operators.normalize import normalize_columns, standardize_points
from probegrid.plans import fixtures as fx
from probegrid.plans import reproduction
from probegrid.schema import POINT_ALIASES
from probegrid.session import stored, work_folder
from probegrid.sources import payloads
from probegrid.sources.tables import default_point_config, describe_outputs, read_table, with_dictionary
from probegrid.streaming import alerts, batches, feeds
from probegrid.streaming.runner import run_to_table, start_append

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles to six places, exact decimal ties always up, -0.0 to 0.0."""
    return df.selectExpr(*[
        f"round(`{f.name}` + 1.2345e-8D, 6) + 0.0D as `{f.name}`" if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema
    ])


# --- shared steps ---------------------------------------------------------------

def points(spark: SparkSession, d: str, **kw) -> quality.PointTables:
    return quality.clean_points(fx.point_raw(spark, d), **kw)


def segments(spark: SparkSession, d: str) -> quality.SegmentTables:
    return quality.clean_segments(fx.segment_raw(spark, d))


def block_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.block_30min(points(spark, d).cleaned, default_point_config(spark))


def matched(spark: SparkSession, d: str) -> DataFrame:
    return grid.match_block_time(block_grid(spark, d), grid.segment_block_time(segments(spark, d).valid))


def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The columns the agreement tables need, stored: each reads them several times."""
    pairs = matched(spark, d).select("block_id", "interval_30min", "date", consistency.X, consistency.Y)
    return stored(pairs, "matched")


# --- sources, normalisation -----------------------------------------------------

def scan_events(spark, d):
    return read_table(spark, f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")


def point_config(spark, d):
    """The layout with the number of raw records each point delivered."""
    seen = fx.point_raw(spark, d).groupBy("point_id").agg(F.count("*").alias("raw_records"))
    layout = default_point_config(spark).select("point_id", "block_id", "corridor_order")
    return layout.join(seen, "point_id", "left").withColumn("raw_records", F.coalesce("raw_records", F.lit(0)))


def normalize_columns_query(spark, d):
    return normalize_columns(fx.messy_points(spark, d), POINT_ALIASES)


def parse_timestamps(spark, d):
    df = standardize_points(fx.messy_points(spark, d))
    return df.select("ingest_seq", F.col("timestamp").alias("parsed"), "interval_15min", "date")


def _floored(minutes):
    def query(spark, d):
        ts = F.col("ts")
        return fx.table(spark, d, "events").select("event_id", scalars.floor_minutes(ts, minutes).alias("slot"))
    return query


def coerce_numeric(spark, d):
    df = standardize_points(fx.messy_points(spark, d))
    return df.select("ingest_seq", "point_id", "current_speed", "free_flow_speed", "current_travel_time", "free_flow_travel_time")


def closure_flag(spark, d):
    return standardize_points(fx.messy_points(spark, d)).select("ingest_seq", "road_closure_bool")


def segment_to_block(spark, d):
    flows = payloads.parse_segment_payloads(fx.segment_payload(spark, d)).flows
    placed = spatial.segment_to_block(flows, fx.place_blocks(spark, d))
    return placed.groupBy("block_id", "place_id").agg(F.count("*").alias("n"), F.sum("speed_kmh").alias("speed_sum"))


def traffic_indicators(spark, d):
    valid = points(spark, d).flagged.where("is_valid_base")
    return with_indicators(valid).select("ingest_seq", "srr", "tti", "ett_seconds", "ci_percent", "ci_negative_flag")


def negative_ci_share(spark, d):
    return points(spark, d).cleaned.groupBy("date").agg(
        F.count_if("ci_negative_flag").alias("negative_records"),
        F.avg(F.col("ci_negative_flag").cast("double")).alias("negative_share"),
    )


# --- quality, dedup ---------------------------------------------------------------

FLAGS_POINT = ["valid_time", "valid_core_fields", "valid_speed", "valid_travel_time", "valid_closure", "confidence_exists", "is_valid_base"]
FLAGS_SEGMENT = ["valid_time", "valid_core_fields", "valid_speed", "valid_jam_factor", "confidence_exists", "is_valid"]


def quality_flags_point(spark, d):
    return points(spark, d).flagged.select("ingest_seq", "interval_15min", "date", *FLAGS_POINT)


def quality_flags_segment(spark, d):
    return segments(spark, d).flagged.select("ingest_seq", "interval_30min", "date", *FLAGS_SEGMENT)


CLEAN_COLUMNS = [
    "point_id", "timestamp", "current_speed", "free_flow_speed", "current_travel_time", "free_flow_travel_time",
    "confidence", "ingest_seq", "interval_15min", "date", "is_duplicate_removed",
    "srr", "tti", "ett_seconds", "ci_percent", "ci_percent_from_tti", "ci_formula_abs_error", "ci_negative_flag",
]


def clean_point(spark, d):
    return points(spark, d).cleaned.select(*CLEAN_COLUMNS)


def clean_point_strict(spark, d):
    return points(spark, d, require_confidence=True).cleaned.select("point_id", "interval_15min", "ingest_seq", "confidence", "ci_percent")


def dedup_point_slot(spark, d):
    return points(spark, d).cleaned.select("point_id", "interval_15min", "timestamp", "ingest_seq")


def duplicate_log(spark, d):
    return points(spark, d).duplicate_log.select("point_id", "interval_15min", "timestamp", "ingest_seq", "date", "is_duplicate_removed")


def _run(spark, d) -> reproduction.Run:
    """The whole workflow, written below the shared folder."""
    out = work_folder(spark, "run")
    return reproduction.run_measured(spark, fx.point_raw(spark, d), fx.segment_raw(spark, d), default_point_config(spark), out)


def run_all(spark, d):
    """Rows of each of the fifteen tables, as counted while they were written, beside those that stand there."""
    run = _run(spark, d)
    there = [t.agg(F.count("*").alias("rows_there")).withColumn("table_name", F.lit(n)) for n, t in run.tables.items()]
    found = there[0]
    for t in there[1:]:
        found = found.unionByName(t)
    return reproduction.table_counts(spark, run).join(found, "table_name")


def run_report(spark, d):
    """Row counts of the main tables of a run."""
    return reproduction.run_report(spark, _run(spark, d))


def describe_outputs_query(spark, d):
    """What the columns of the cleaned table are, with the dictionary entries that know them."""
    entries = fx.dictionary(spark, d)
    return describe_outputs(with_dictionary(points(spark, d).cleaned.select(*CLEAN_COLUMNS), entries))


# --- grid, agreement ---------------------------------------------------------------

def unassigned_points(spark, d):
    first = default_point_config(spark).where("block_id = '1'")
    return grid.unassigned_points(points(spark, d).cleaned, first)


def block_30min_weighted(spark, d):
    return grid.block_30min_weighted(points(spark, d).cleaned, default_point_config(spark), fx.point_weights(spark, d))


def _cells(spark, d):
    """Point records with their block: far more rows per unit than the matched table."""
    cells = grid.assign_blocks(points(spark, d).cleaned, default_point_config(spark))
    return stored(cells.select("block_id", "srr", "ci_percent"), "cells")


def pearson_by_block(spark, d):
    """Speed loss against congestion of the point records, per block."""
    return consistency.consistency_stats(_cells(spark, d), ["block_id"], "srr", "ci_percent").select("block_id", "matched_n", "pearson_r")


def spearman_by_block(spark, d):
    s = consistency.consistency_stats(_cells(spark, d), ["block_id"], "srr", "ci_percent")
    return s.select("block_id", "matched_n", "spearman_rho")


def peak_thresholds(spark, d):
    m = pooled(matched_pairs(spark, d))
    levels = {"q80": 0.8, "q85": 0.85, "q90": 0.9, "q95": 0.95}
    found = percentiles(m, ["unit"], [consistency.X, consistency.Y], levels)
    return found.select("unit", F.inline(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(f"{v}_n").alias("unit_n"), *[F.col(f"{v}_{q}").alias(q) for q in levels])
        for v in (consistency.X, consistency.Y)
    ])))


def peak_overlap(spark, d):
    s = consistency.consistency_stats(matched_pairs(spark, d), ["block_id"])
    return s.select("block_id", "matched_n", "peak_overlap_index")


def release_checks(spark, d):
    return reproduction.run_checks(spark, _run(spark, d))


def run_updated(spark, d):
    """A run over the first twenty days, brought up to date by the last ten; counts and sums of its tables."""
    out = work_folder(spark, "run")
    day = F.dayofmonth("ts")
    events = fx.table(spark, d, "events")
    first = events.where(day <= 20)
    reproduction.run_measured(spark, fx.point_raw_of(first), fx.segment_raw_of(first), default_point_config(spark), out)
    late = events.where(day > 20)
    dates = reproduction.touched_dates(quality.clean_points(fx.point_raw_of(late)).flagged, quality.clean_segments(fx.segment_raw_of(late)).flagged)
    tables = reproduction.update_run(spark, fx.point_raw_of(events), fx.segment_raw_of(events), default_point_config(spark), out, dates)
    logs = [tables[n].select(F.lit(n).alias("table_name"), "date", F.col("raw_records"), F.col("valid_records")) for n in ("tomtom_cleaning_log_by_date", "here_cleaning_log_by_date")]
    grids = [tables[n].groupBy("date").agg(F.count("*").alias("raw_records"), F.lit(None).cast("bigint").alias("valid_records")).select(F.lit(n).alias("table_name"), "date", "raw_records", "valid_records")
             for n in ("tomtom_duplicate_log", "matched_tomtom_here_30min")]
    out = logs[0]
    for t in [*logs[1:], *grids]:
        out = out.unionByName(t)
    return out.withColumnRenamed("raw_records", "records")


# --- documents -----------------------------------------------------------------------

def ingest_point_json(spark, d):
    return payloads.parse_point_payloads(fx.point_payload(spark, d)).flows


def ingest_point_coords(spark, d):
    return payloads.parse_point_payloads(fx.point_payload(spark, d)).shapes


def ingest_segment_json(spark, d):
    return payloads.parse_segment_payloads(fx.segment_payload(spark, d)).flows


def ingest_segment_shape(spark, d):
    return payloads.parse_segment_payloads(fx.segment_payload(spark, d)).shapes


def ingest_rejects(spark, d):
    p = payloads.parse_point_payloads(fx.point_payload(spark, d)).rejects
    s = payloads.parse_segment_payloads(fx.segment_payload(spark, d)).rejects
    return p.select(F.lit("point").alias("feed"), F.col("point_uuid").alias("doc_id"), "reject_reason").unionByName(
        s.select(F.lit("segment").alias("feed"), F.col("batch_id").alias("doc_id"), "reject_reason")
    )


def _segment_tables(spark, d) -> payloads.Ingested:
    """Tables of the segment documents for queries that read several: parsed once, and stored with the texts of rejects only."""
    def settle(parsed):
        text = F.when(F.col("reject_reason").isNotNull(), F.col("js"))
        return stored(parsed.withColumn("js", text), "segment-documents")
    return payloads.parse_segment_payloads(fx.segment_payload(spark, d), settle=settle)


def segment_geometry(spark, d):
    t = _segment_tables(spark, d)
    path = F.col("path")
    return lineage.segment_geometry(t.flows, t.shapes).select(
        "uuid",
        F.size(path).alias("path_points"),
        F.concat_ws(",", F.transform(path, lambda p: p["sequence_order"].cast("string"))).alias("path_order"),
        path[0]["longitude"].alias("first_longitude"),
        F.element_at(path, -1)["latitude"].alias("last_latitude"),
    )


def functional_class_compare(spark, d):
    t = _segment_tables(spark, d)
    return patterns.functional_class_compare(t.flows, t.shapes)


def ingested_segment_grid(spark, d):
    """Documents to block-time grid: ingest, block lookup, cleaning, aggregation."""
    flows = payloads.parse_segment_payloads(fx.segment_payload(spark, d)).flows
    feed = stored(payloads.segment_feed(flows, fx.place_blocks(spark, d)), "segment-feed")
    return grid.segment_block_time(quality.clean_segments(feed).valid).select(
        "block_id", "interval_30min", "here_mean_speed", "here_median_jam_factor", "here_segment_count", "here_record_count"
    )


def _lineage(operator, *columns: str):
    def query(spark, d):
        found = operator(fx.assigned_flows(spark, d), fx.assignments(spark, d), fx.monitor_points(spark, d))
        return found.select(*columns) if columns else found
    return query


def points_in_bbox(spark, d):
    return spatial.points_in_boxes(fx.vehicle_positions(spark, d), fx.boxes(spark, d)).select("event_id", "name")


def segment_to_block_by_position(spark, d):
    """Segments placed on the map: the block around the start of their geometry."""
    shapes = payloads.parse_segment_payloads(fx.segment_payload(spark, d)).shapes
    return spatial.blocks_by_position(spatial.first_positions(shapes), fx.block_boxes(spark, d), "bbox_uuid")


def unweighted_points(spark, d):
    return grid.unweighted_points(points(spark, d).cleaned, fx.point_weights(spark, d))


# --- operations ------------------------------------------------------------------------

def round_robin_assign(spark, d):
    return operations.round_robin_assign(fx.monitor_points(spark, d), fx.api_keys(spark, d), "run-1", seed=7)


def ordered_assign(spark, d):
    a = operations.ordered_assign(fx.monitor_points(spark, d), fx.api_keys(spark, d), "run-1", "c_custkey")
    return a.select("uuid", "pd_uuid", "key_number", "point_uuid")


def ordered_assign_filtered(spark, d):
    a = operations.ordered_assign(fx.monitor_points(spark, d), fx.api_keys(spark, d), "run-1", "c_custkey", filter_first=True)
    return a.select("key_number", "point_uuid")


def assignment_balance(spark, d):
    return operations.assignment_balance(fx.assignments(spark, d), planned=50)


def run_completeness(spark, d):
    return operations.run_completeness(fx.assignments(spark, d), fx.assigned_flows(spark, d))


def key_usage_daily(spark, d):
    return operations.key_usage_daily(fx.key_runs(spark, d))


def key_usage_dense(spark, d):
    return operations.key_usage_dense(fx.api_keys(spark, d), operations.key_usage_daily(fx.key_runs(spark, d)))


def key_quota_use(spark, d):
    return operations.key_quota_use(fx.api_keys(spark, d), operations.key_usage_daily(fx.key_runs(spark, d)))


def latest_failed_job(spark, d):
    return operations.latest_failed_job(fx.job_logs(spark, d)).select("uuid", "job_name", "start_time", "end_time", "status")


def current_job_state(spark, d):
    return operations.current_job_state(fx.job_log_updates(spark, d))


def job_run_summary(spark, d):
    return operations.job_run_summary(fx.job_logs(spark, d))


def heartbeat_outages(spark, d):
    return operations.heartbeat_outages(fx.heartbeats(spark, d))


# --- patterns -----------------------------------------------------------------------------

def weekly_heatmap(spark, d):
    table = patterns.weekly_heatmap(points(spark, d).cleaned)
    return table.select("hour", *[F.col(str(i)).alias(f"day_{i}") for i in range(7)])


def boxplot_stats(spark, d):
    day_type = scalars.day_type(F.col("interval_15min")).alias("day_type")
    cleaned = stored(points(spark, d).cleaned.select(day_type, "ci_percent"), "cleaned")
    return patterns.boxplot_stats(cleaned, ["day_type"])


def impact_comparison(spark, d):
    return patterns.impact_comparison(points(spark, d).cleaned, fx.day_labels(spark, d))


def impact_tests(spark, d):
    cleaned = stored(points(spark, d).cleaned.select("date", "ci_percent"), "cleaned")
    return patterns.impact_tests(cleaned, fx.day_labels(spark, d))


def bottlenecks(spark, d):
    cleaned = stored(points(spark, d).cleaned.select("point_id", "interval_15min", "ci_percent"), "cleaned")
    return patterns.bottlenecks(cleaned, default_point_config(spark))


def time_space_matrix(spark, d):
    return patterns.time_space_matrix(points(spark, d).cleaned, default_point_config(spark))


def time_space_long(spark, d):
    return patterns.time_space_long(points(spark, d).cleaned, default_point_config(spark))


def _of_cleaned(operator):
    return lambda spark, d: operator(points(spark, d).cleaned)


def _of_stored(operator, *columns: str):
    """For operators that read their input more than once."""
    return lambda spark, d: operator(stored(points(spark, d).cleaned.select(*columns), "cleaned"))


def _of_layout(operator):
    return lambda spark, d: operator(points(spark, d).cleaned, default_point_config(spark))


def _of_matched(operator):
    return lambda spark, d: operator(matched_pairs(spark, d))


BATCH: dict[str, Query] = {
    "scan_events": scan_events,
    "point_config": point_config,
    "normalize_columns": normalize_columns_query,
    "parse_timestamps": parse_timestamps,
    "floor_15min": _floored(15),
    "floor_30min": _floored(30),
    "coerce_numeric": coerce_numeric,
    "closure_flag": closure_flag,
    "segment_to_block": segment_to_block,
    "traffic_indicators": traffic_indicators,
    "negative_ci_share": negative_ci_share,
    "ci_formula_check": _of_cleaned(quality.formula_check),
    "quality_flags_point": quality_flags_point,
    "quality_flags_segment": quality_flags_segment,
    "clean_point": clean_point,
    "clean_point_strict": clean_point_strict,
    "dedup_point_slot": dedup_point_slot,
    "duplicate_log": duplicate_log,
    "cleaning_log_point": lambda s, d: points(s, d).cleaning_log,
    "cleaning_log_segment": lambda s, d: segments(s, d).cleaning_log,
    "daily_availability": lambda s, d: points(s, d).daily_availability,
    "run_all": run_all,
    "run_report": run_report,
    "run_updated": run_updated,
    "describe_outputs": describe_outputs_query,
    "unassigned_points": unassigned_points,
    "point_30min": _of_layout(grid.point_30min),
    "block_30min": block_grid,
    "block_30min_weighted": block_30min_weighted,
    "segment_block_time": lambda s, d: grid.segment_block_time(segments(s, d).valid),
    "match_block_time": matched,
    "pearson_by_block": pearson_by_block,
    "spearman_by_block": spearman_by_block,
    "peak_thresholds": peak_thresholds,
    "peak_overlap": peak_overlap,
    "benchmark_summary": _of_matched(consistency.benchmark_summary),
    "sensitivity_threshold": _of_matched(consistency.sensitivity_threshold),
    "sensitivity_lag": _of_matched(consistency.sensitivity_lag),
    "sensitivity_per_block": _of_matched(consistency.sensitivity_per_block),
    "sensitivity_daily": _of_matched(consistency.sensitivity_daily),
    "release_checks": release_checks,
    "intraday_profile": _of_cleaned(profiles.intraday_profile),
    "day_type_profile": _of_cleaned(profiles.day_type_profile),
    "profile_zscore": _of_cleaned(lambda c: profiles.with_zscores(profiles.intraday_profile(c))),
    "moving_average": _of_cleaned(profiles.moving_average),
    "ingest_point_json": ingest_point_json,
    "ingest_point_coords": ingest_point_coords,
    "ingest_segment_json": ingest_segment_json,
    "ingest_segment_shape": ingest_segment_shape,
    "ingest_rejects": ingest_rejects,
    "ingested_segment_grid": ingested_segment_grid,
    "segment_geometry": segment_geometry,
    "flow_to_point": _lineage(lineage.flow_to_point, "uuid", "point_uuid", "pd_uuid", "point_id", "capture_time", "current_speed"),
    "unlinked_flows": _lineage(lineage.unlinked_flows, "uuid", "point_uuid", "link"),
    "lineage_report": _lineage(lineage.lineage_report),
    "points_in_bbox": points_in_bbox,
    "unusable_boxes": lambda s, d: spatial.unusable_boxes(fx.boxes(s, d)),
    "segment_to_block_by_position": segment_to_block_by_position,
    "unweighted_points": unweighted_points,
    "round_robin_assign": round_robin_assign,
    "ordered_assign": ordered_assign,
    "ordered_assign_filtered": ordered_assign_filtered,
    "assignment_balance": assignment_balance,
    "run_completeness": run_completeness,
    "key_usage_daily": key_usage_daily,
    "key_usage_dense": key_usage_dense,
    "key_quota_use": key_quota_use,
    "latest_failed_job": latest_failed_job,
    "current_job_state": current_job_state,
    "job_run_summary": job_run_summary,
    "heartbeat_outages": heartbeat_outages,
    "weekly_distribution": _of_stored(patterns.weekly_distribution, "interval_15min", "ci_percent"),
    "weekly_heatmap": weekly_heatmap,
    "monthly_trend": _of_cleaned(patterns.monthly_trend),
    "daily_fluctuation": _of_cleaned(patterns.daily_fluctuation),
    "boxplot_stats": boxplot_stats,
    "impact_comparison": impact_comparison,
    "hotspot_topk": _of_stored(patterns.hotspots, "point_id", "ci_percent"),
    "segment_speed_profile": _of_layout(patterns.speed_profile),
    "functional_class_compare": functional_class_compare,
    "time_space_matrix": time_space_matrix,
    "time_space_long": time_space_long,
    "impact_tests": impact_tests,
    "bottlenecks": bottlenecks,
    "peak_spreading": _of_stored(patterns.peak_spreading, "date", "interval_15min", "ci_percent"),
    "weekly_spreading": _of_stored(patterns.weekly_spreading, "date", "interval_15min", "ci_percent"),
    "peak_hour_shift": _of_stored(patterns.peak_hours, "date", "interval_15min", "ci_percent"),
}


# --- streams ---------------------------------------------------------------------------------

def stream_ingest(spark, d):
    flows = feeds.point_ingest(spark, fx.landed_point_payloads(spark, d)).flows
    return run_to_table(flows, "stream-ingest")


def _valid_point_stream(spark, d):
    return quality.clean_points(fx.point_raw_of(fx.events_stream(spark, d))).valid


def stream_dedup(spark, d):
    wanted = _valid_point_stream(spark, d).select("point_id", "interval_15min", "timestamp", "ingest_seq")
    return run_to_table(feeds.dedup_stream(wanted), "stream-dedup").drop("slot_time")


def stream_block_time(spark, d):
    valid = quality.clean_segments(fx.segment_raw_of(fx.events_stream(spark, d))).valid
    return run_to_table(feeds.segment_windows(valid), "stream-block-time")


def stream_availability(spark, d):
    wanted = _valid_point_stream(spark, d).select("point_id", "timestamp", "ingest_seq")
    return run_to_table(feeds.availability_stream(wanted), "stream-availability")


def stream_heartbeat(spark, d):
    sessions = feeds.heartbeat_sessions(fx.heartbeats_of(fx.events_stream(spark, d)))
    outages = feeds.outages_of(run_to_table(sessions, "stream-heartbeat"))
    silent = scalars.interval_seconds(F.col("recovered_at") - F.col("last_beat")).cast("double")
    return outages.withColumn("silent_seconds", silent)


def _ingested(landed, ingest, parse, name: str):
    """Three micro-batches of documents into three tables, of which one is read back."""
    def query(spark, d):
        folder = work_folder(spark, "ingest")
        documents = ingest(spark, landed(spark, d), maxFilesPerTrigger=str(fx.files_per_share(spark)))
        batches.start_ingest(documents, parse, f"{folder}/tables", f"{folder}/checkpoint").awaitTermination()
        return batches.read_ingested(spark, f"{folder}/tables", name, getattr(parse(documents), name).schema)
    return query


POINT_DOCUMENTS = (fx.landed_point_payloads, feeds.point_documents, payloads.parse_point_payloads)
SEGMENT_DOCUMENTS = (fx.landed_segment_payloads, feeds.segment_documents, payloads.parse_segment_payloads)


def _rejects(documents, feed: str, key: str):
    def query(spark, d):
        return _ingested(*documents, "rejects")(spark, d).select(F.lit(feed).alias("feed"), F.col(key).alias("doc_id"), "reject_reason")
    return query


def stream_running_availability(spark, d):
    """Days 1-10, then 21-30, then 11-20, in three runs."""
    folder = work_folder(spark, "availability")

    def start(events):
        valid = quality.clean_points(fx.point_raw_of(events)).valid
        return batches.start_availability(valid, f"{folder}/tables", f"{folder}/checkpoint")

    fx.events_in_runs(spark, d, (0, 2, 1), start)
    return batches.read_availability(spark, f"{folder}/tables", points(spark, d).daily_availability.schema)


def _audited(spark, d, order, delay_minutes):
    folder = work_folder(spark, "windows")

    def start(events):
        flagged = quality.clean_segments(fx.segment_raw_of(events)).flagged
        return batches.start_segment_windows(flagged, f"{folder}/tables", f"{folder}/checkpoint", delay_minutes)

    fx.events_in_runs(spark, d, order, start)
    return f"{folder}/tables"


def stream_window_audit(spark, d):
    """The middle part arrives last and is late; undated records stand aside in every batch."""
    return batches.read_audit(spark, _audited(spark, d, (0, 2, 1), 30))


def stream_windows_in_order(spark, d):
    return batches.read_segment_windows(spark, _audited(spark, d, (0, 1, 2), 30))


def stream_aside(spark, d):
    out = _audited(spark, d, (0, 2, 1), 30)
    return batches.read_aside(spark, out, segments(spark, d).flagged.schema).groupBy("micro_batch", "fate").agg(
        F.count("*").alias("records"), F.min("ingest_seq").alias("first_seq"), F.sum("ingest_seq").alias("seq_sum"))


def _alert_events(spark, d):
    folder = work_folder(spark, "alerts")

    def start(events):
        return start_append(alerts.outage_events(fx.heartbeats_of(events)), f"{folder}/events", f"{folder}/checkpoint")

    fx.events_in_runs(spark, d, (0, 1, 2), start, closing=True)
    return spark.read.parquet(f"{folder}/events")


def stream_outages(spark, d):
    return alerts.ended_outages(_alert_events(spark, d))


def stream_open_outages(spark, d):
    return alerts.open_outages(_alert_events(spark, d)).where("job_name <> 'closing'")


STREAMS: dict[str, Query] = {
    "stream_ingest": stream_ingest,
    "stream_dedup": stream_dedup,
    "stream_block_time": stream_block_time,
    "stream_availability": stream_availability,
    "stream_heartbeat": stream_heartbeat,
    "stream_point_flows": _ingested(*POINT_DOCUMENTS, "flows"),
    "stream_point_shapes": _ingested(*POINT_DOCUMENTS, "shapes"),
    "stream_point_rejects": _rejects(POINT_DOCUMENTS, "point", "point_uuid"),
    "stream_segment_flows": _ingested(*SEGMENT_DOCUMENTS, "flows"),
    "stream_segment_shapes": _ingested(*SEGMENT_DOCUMENTS, "shapes"),
    "stream_segment_rejects": _rejects(SEGMENT_DOCUMENTS, "segment", "batch_id"),
    "stream_running_availability": stream_running_availability,
    "stream_window_audit": stream_window_audit,
    "stream_windows_in_order": stream_windows_in_order,
    "stream_aside": stream_aside,
    "stream_outages": stream_outages,
    "stream_open_outages": stream_open_outages,
}


def all_queries() -> dict[str, Query]:
    def finish(query: Query) -> Query:
        return lambda spark, d: rounded(query(spark, d))

    return {name: finish(query) for name, query in {**BATCH, **STREAMS}.items()}
