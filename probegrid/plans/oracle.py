"""Independent DuckDB statements of every registered query.

They restate the definitions with plain windows and built-in quantiles over
whole tables; none of them mirrors how the Spark plan gets there.

Doubles are rounded to six places. The small amount added first moves exact
decimal ties (1.0011875), which engines round either way, to one side; the
queries add the same.
"""

from __future__ import annotations


def _r(expr: str, name: str) -> str:
    return f"round({expr} + 1.2345e-8, 6) + 0.0 as {name}"


def _rs(*names: str) -> str:
    return ", ".join(_r(n, n) for n in names)


POINT_RAW = """
point_raw as (
  select 'P' || lpad((user_id % 42 + 1)::varchar, 2, '0') as point_id,
    case when event_id % 97 = 0 then null else date_trunc('second', ts) end as "timestamp",
    case when event_id % 61 = 0 then null when event_id % 53 = 0 then 0.0::double when event_id % 59 = 0 then -1.0::double
         else 60.0::double + (user_id % 5) * 10 - value / 12 end as current_speed,
    60.0::double + (user_id % 5) * 10 as free_flow_speed,
    case when event_id % 67 = 0 then 0.0::double else 95.0::double + (user_id % 7) * 10 + value / 3 end as current_travel_time,
    100.0::double + (user_id % 7) * 10 as free_flow_travel_time,
    case when event_id % 11 = 0 then null else 0.5::double + (event_id % 50) / 100.0::double end as confidence,
    case when event_id % 101 = 0 then 'Closed' when event_id % 103 = 0 then ' YES '
         when event_id % 2 = 0 then '0' else null end as road_closure,
    event_id as ingest_seq
  from events)"""

POINT_FLAGGED = POINT_RAW + """,
point_flagged as (
  select *, time_bucket(interval '15 minutes', "timestamp") as interval_15min,
    cast(time_bucket(interval '15 minutes', "timestamp") as date) as "date",
    "timestamp" is not null as valid_time,
    "timestamp" is not null and current_speed is not null as valid_core_fields,
    coalesce(current_speed > 0 and free_flow_speed > 0, false) as valid_speed,
    coalesce(current_travel_time > 0 and free_flow_travel_time > 0, false) as valid_travel_time,
    coalesce(lower(trim(road_closure)) not in ('1','true','yes','y','closed','closure','road_closed'), true) as valid_closure,
    confidence is not null as confidence_exists
  from point_raw),
point_valid as (
  select *, row_number() over (partition by point_id, interval_15min order by "timestamp", ingest_seq) as nth
  from (select *, valid_time and valid_core_fields and valid_speed and valid_travel_time and valid_closure as is_valid_base
        from point_flagged) where is_valid_base)"""

CLEANED = POINT_FLAGGED + """,
cleaned as (
  select *, false as is_duplicate_removed,
    (free_flow_speed - current_speed) / free_flow_speed as srr,
    current_travel_time / free_flow_travel_time as tti,
    current_travel_time - free_flow_travel_time as ett_seconds,
    (current_travel_time - free_flow_travel_time) / free_flow_travel_time * 100 as ci_percent,
    (current_travel_time / free_flow_travel_time - 1) * 100 as ci_percent_from_tti,
    current_travel_time < free_flow_travel_time as ci_negative_flag
  from point_valid where nth = 1)"""

CONFIG = """
config as (
  select 'P' || lpad(n::varchar, 2, '0') as point_id, (1 + (n - 1) // 14)::varchar as block_id, n::int as corridor_order
  from range(1, 43) t(n))"""

SEGMENT_FLAGGED = """
segment_flagged as (
  select *, time_bucket(interval '30 minutes', "timestamp") as interval_30min,
    cast(time_bucket(interval '30 minutes', "timestamp") as date) as "date",
    "timestamp" is not null as valid_time,
    "timestamp" is not null and speed is not null and jam_factor is not null as valid_core_fields,
    coalesce(speed > 0, false) as valid_speed,
    coalesce(jam_factor >= 0, false) as valid_jam_factor,
    confidence is not null as confidence_exists
  from (select (1 + event_id % 3)::varchar as block_id,
          case when event_id % 89 = 0 then null else ts end as "timestamp",
          case when event_id % 43 = 0 then 0.0::double when event_id % 73 = 0 then null else 80.0::double - value / 12 end as speed,
          case when event_id % 47 = 0 then -1.0::double else value / 60 end as jam_factor,
          case when event_id % 17 = 0 then null else 0.25::double + (event_id % 3) / 4.0::double end as confidence,
          case when event_id % 13 = 0 then null else 'S' || (user_id % 20)::varchar end as segment_id,
          event_id as ingest_seq from events)),
segment_valid as (
  select * from segment_flagged where valid_time and valid_core_fields and valid_speed and valid_jam_factor)"""

BLOCK = CLEANED + "," + CONFIG + """,
point_30 as (
  select block_id, point_id, time_bucket(interval '30 minutes', interval_15min) as interval_30min,
    avg(current_speed) as tomtom_current_speed, avg(free_flow_speed) as tomtom_free_flow_speed,
    avg(current_travel_time) as tomtom_current_travel_time, avg(free_flow_travel_time) as tomtom_free_flow_travel_time,
    avg(ci_percent) as tomtom_ci_percent, avg(tti) as tomtom_tti, avg(srr) as tomtom_srr, avg(ett_seconds) as tomtom_ett_seconds,
    count(*) as tomtom_15min_count
  from cleaned join config using (point_id) group by all),
block_30 as (
  select block_id, interval_30min,
    avg(tomtom_current_speed) as tomtom_mean_current_speed, avg(tomtom_free_flow_speed) as tomtom_mean_free_flow_speed,
    avg(tomtom_current_travel_time) as tomtom_mean_current_travel_time,
    avg(tomtom_free_flow_travel_time) as tomtom_mean_free_flow_travel_time,
    avg(tomtom_ci_percent) as tomtom_mean_ci_percent, median(tomtom_ci_percent) as tomtom_median_ci_percent,
    avg(tomtom_tti) as tomtom_mean_tti, avg(tomtom_srr) as tomtom_mean_srr, avg(tomtom_ett_seconds) as tomtom_mean_ett_seconds,
    count(distinct point_id) as tomtom_point_count, sum(tomtom_15min_count)::bigint as tomtom_record_count_15min,
    cast(interval_30min as date) as "date"
  from point_30 group by block_id, interval_30min)"""

SEGMENT_BLOCK = SEGMENT_FLAGGED + """,
segment_30 as (
  select block_id, interval_30min, avg(speed) as here_mean_speed, median(speed) as here_median_speed,
    avg(jam_factor) as here_mean_jam_factor, median(jam_factor) as here_median_jam_factor,
    count(distinct segment_id) as here_segment_count, count(*) as here_record_count,
    avg(confidence) as here_mean_confidence, cast(interval_30min as date) as "date"
  from segment_valid group by block_id, interval_30min)"""

MATCHED = BLOCK + "," + SEGMENT_BLOCK + """,
matched as (
  select b.* exclude ("date"), b."date" as date_tomtom, s.* exclude (block_id, interval_30min, "date"), s."date" as date_here,
    cast(b.interval_30min as date) as "date",
    tomtom_mean_ci_percent as x, here_mean_jam_factor as y
  from block_30 b join segment_30 s using (block_id, interval_30min))"""


def _stats(source: str, quantiles: tuple[float, ...] = (0.85,)) -> str:
    """CTEs ``stats`` (per unit) from ``source`` with columns unit, x, y."""
    overlaps = ", ".join(
        f"count(*) filter (where x >= tx_{i} and y >= ty_{i}) / nullif(count(*) filter (where x >= tx_{i} or y >= ty_{i}), 0)::double as overlap_{i}"
        for i in range(len(quantiles))
    )
    limits = ", ".join(
        f"quantile_cont(x, {q}) as tx_{i}, quantile_cont(y, {q}) as ty_{i}" for i, q in enumerate(quantiles)
    )
    return f"""
pairs as (select unit, x, y from {source} where x is not null and y is not null),
ranked as (
  select *, rank() over (partition by unit order by x) + (count(*) over (partition by unit, x) - 1) / 2.0::double as rx,
    rank() over (partition by unit order by y) + (count(*) over (partition by unit, y) - 1) / 2.0::double as ry
  from pairs),
limits as (select unit, {limits} from pairs group by unit),
stats as (
  select unit, count(*) as matched_n,
    avg(x) as x_mean, median(x) as x_median, stddev_samp(x) as x_sd, min(x) as x_min, max(x) as x_max,
    avg(y) as y_mean, median(y) as y_median, stddev_samp(y) as y_sd, min(y) as y_min, max(y) as y_max,
    case when count(*) >= 3 then covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) end as pearson_r,
    case when count(*) >= 3 then covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) end as spearman_rho,
    {overlaps}
  from ranked join limits using (unit) group by unit)"""


MESSY = """
messy as (
  select event_id, user_id, ts,
    case event_id % 5 when 1 then date_trunc('minute', ts) when 4 then null else date_trunc('second', ts) end as parsed
  from events)"""

POINT_DOCS = """
docs as (
  select *, event_id % 37 <> 0 and event_id % 41 <> 0 and event_id % 43 <> 0 and event_id % 47 <> 0 as good,
    md5('A' || event_id::varchar || '#' || strftime(ts, '%Y-%m-%d %H:%M:%S') ||
        case when microsecond(ts) % 1000000 = 0 then '' else '.' || rtrim(lpad((microsecond(ts) % 1000000)::varchar, 6, '0'), '0') end) as flow_id
  from events)"""

SEGMENT_DOCS = """
seg as (
  select *, event_id // 10 as batch_no, (event_id // 10) % 29 <> 0 as good,
    'B' || (event_id // 10)::varchar as batch_id, 'place ' || ((event_id // 10) % 12)::varchar as place_id,
    min(ts) over (partition by event_id // 10) as capture_time,
    'B' || (event_id // 10)::varchar || '#' || 'place ' || ((event_id // 10) % 12)::varchar || '#' || (event_id % 10)::varchar as doc_key
  from events),
seg_flow as (
  select event_id, md5(doc_key) as uuid, md5('shape#' || doc_key) as bbox_uuid, batch_id, place_id, capture_time,
    'Road ' || (user_id % 20)::varchar as road_name, (1 + event_id % 3)::int as number_roads,
    case when event_id % 19 = 0 then 0.0::double else 80.0::double - value / 12 end as speed_kmh,
    case when event_id % 19 = 0 then 0.0::double else value / 60 end as jam_factor
  from seg where good),
seg_shape as (
  select md5('shape#' || doc_key) as flow_uuid, 1.0::double + l / 64.0::double as latitude,
    110.0::double + p / 64.0::double + event_id / 1048576.0::double as longitude,
    (1 + (event_id + l) % 5)::int as functional_class, 'Road ' || (user_id % 20)::varchar as all_description_str,
    (100 + event_id % 50)::int as all_length, (10 * l)::int as zl_length,
    ((l - 1) * (2 + event_id % 2) + p)::int as sequence_order
  from seg, range(1, 4) a(l), range(1, 4) b(p) where good and l <= 1 + event_id % 3 and p <= 2 + event_id % 2),
places as (select distinct 'place ' || ((event_id // 10) % 12)::varchar as place_id, (1 + (event_id // 10) % 12 % 3)::varchar as block_id from events)"""

JOBS = """
jobs as (
  select 'J' || event_id::varchar as uuid, event_type as job_name, ts as start_time,
    case when event_id % 71 = 0 then null else ts + to_seconds(30 + event_id % 600) end as end_time,
    case when event_id % 71 = 0 then 'RUNNING' when event_type = 'error' or event_id % 23 = 0 then 'FAILED' else 'SUCCESS' end as status,
    case when event_id % 3 = 0 then null else 42 end as total_points,
    case when event_id % 3 = 0 then null else (42 - event_id % 5)::int end as success_points
  from events)"""

USAGE = """
keys as (
  select 'K' || lpad(n_nationkey::varchar, 2, '0') as uuid, case when n_nationkey % 5 < 4 then 'TOMTOM' else 'HERE' end as platform,
    10 + n_nationkey as daily_limit, 300 + 10 * n_nationkey as monthly_limit from nation),
usage as (
  select 'K' || lpad((user_id % 20)::varchar, 2, '0') as api_key_uuid, cast(ts as date) as usage_date,
    count(*) as request_count, count(*) filter (where event_type = 'error') as error_count
  from events group by 1, 2)"""

MOVED = "cast(1 + o_custkey // 1000 * 0.001 + case when o_orderkey % 71 = 0 then 0.0005 else 0 end as decimal(10,7)) as latitude, cast(110 + o_custkey % 1000 * 0.001 as decimal(10,7)) as longitude"
POSITION = "cast(1 + {0} // 1000 * 0.001 as decimal(10,7)) as latitude, cast(110 + {0} % 1000 * 0.001 as decimal(10,7)) as longitude"

ASSIGNED = f"""
assigned as (
  select 'O' || o_orderkey::varchar as uuid, 'R' || (o_orderkey // 50)::varchar as pd_uuid,
    'K' || lpad((o_orderkey % 20)::varchar, 2, '0') as key_number, o_orderkey, o_orderdate, o_custkey,
    o_orderkey % 50 < 50 - o_orderkey // 50 % 7 as captured
  from orders)"""

TRACED = ASSIGNED + f""",
site as (select 'Site ' || c_custkey::varchar as point_id, {POSITION.format("c_custkey")} from customer),
link as (select uuid, pd_uuid, {MOVED} from assigned),
flow as (
  select 'F' || o_orderkey::varchar as uuid, case when o_orderkey % 83 = 0 then 'lost' else 'O' || o_orderkey::varchar end as point_uuid,
    o_orderdate as capture_time, (40 + o_orderkey % 60)::int as current_speed
  from assigned where captured),
traced as (
  select f.*, pd_uuid, point_id, case when l.uuid is null then 'no_assignment' when point_id is null then 'no_point' else 'linked' end as link
  from flow f left join link l on l.uuid = f.point_uuid left join site using (latitude, longitude))"""

SUMMARY_COLUMNS = (
    "unit, matched_n, "
    + ", ".join(_r(f"{s}_{m}", f"{n}_{m}") for s, n in (("x", "tomtom_ci"), ("y", "here_jf")) for m in ("mean", "median", "sd", "min", "max"))
    + ", " + _rs("pearson_r", "spearman_rho") + ", 0.85::double as peak_overlap_q, " + _r("overlap_0", "peak_overlap_index")
)


def _unit_table(unit: str) -> str:
    return (
        "with " + MATCHED + f", unit_rows as (select {unit} as unit, x, y from matched)," + _stats("unit_rows")
        + f" select unit as {unit}, matched_n, {_rs('pearson_r', 'spearman_rho')}, 0.85::double as peak_overlap_q, "
        + _r("overlap_0", "peak_overlap_index") + ", " + _r("x_mean", "tomtom_ci_mean") + ", " + _r("y_mean", "here_jf_mean")
        + " from stats"
    )


def _correlation_by_block(column: str) -> str:
    return (
        "with " + CLEANED + "," + CONFIG + ", unit_rows as (select block_id as unit, srr as x, ci_percent as y from cleaned join config using (point_id)),"
        + _stats("unit_rows") + f" select unit as block_id, matched_n, {_rs(column)} from stats"
    )


def _deal(points_filter: str, key_filter: str, columns: str, order: str = "c_custkey") -> str:
    return f"""
with {USAGE},
site as (select 'M' || c_custkey::varchar as uuid, c_custkey, {POSITION.format("c_custkey")} from customer),
dealt as (select *, row_number() over (order by {order}) - 1 as turn from site),
seats as (select uuid as key_number, platform, row_number() over (order by uuid) - 1 as seat from keys {key_filter})
select {columns} from dealt join (select key_number, platform, seat from seats) s on turn % (select count(*) from seats) = s.seat where {points_filter}"""


STREAM_SEGMENT = "with " + SEGMENT_BLOCK + f" select block_id, interval_30min, {_rs('here_mean_speed', 'here_mean_jam_factor', 'here_mean_confidence')}, here_record_count from segment_30"
DEDUP = "with " + CLEANED + ' select point_id, interval_15min, "timestamp", ingest_seq from cleaned'
OUTAGES = """
with beats as (
  select event_type as job_name, ts, lag(ts) over (partition by event_type order by ts) as prev from events where event_type <> 'error')
select job_name, prev as last_beat, prev + interval '15 minutes' as alert_at, ts as recovered_at,
  round((epoch_us(ts) - epoch_us(prev)) / 1000000.0::double + 1.2345e-8, 6) + 0.0 as silent_seconds
from beats where ts > prev + interval '15 minutes'"""
SPREADING = CLEANED + """,
slots as (select "date", time_bucket(interval '30 minutes', interval_15min) as slot, avg(ci_percent) as ci from cleaned group by 1, 2),
high as (select *, hour(slot) * 2 + minute(slot) // 30 as number from slots where ci >= (select quantile_cont(ci, 0.85) from slots)),
runs as (select *, number - row_number() over (partition by "date" order by number) as run from high),
stretches as (select "date", run, min(slot) as start, count(*) as n from runs group by 1, 2),
longest as (select *, row_number() over (partition by "date" order by n desc, start) as nth, sum(n) over (partition by "date") as total, count(*) over (partition by "date") as parts from stretches),
spreading as (
  select "date", coalesce(total, 0)::bigint as peak_slots, coalesce(parts, 0)::bigint as stretches, coalesce(n, 0)::bigint as longest_slots,
    start as longest_start, start + to_minutes(30 * n) as longest_end
  from (select distinct "date" from slots) left join (select * from longest where nth = 1) using ("date"))
"""
AUDIT = """
with arrived as (
  select *, [0, 2, 1][1 + least(2, (day(ts) - 1) // 10)]::bigint as micro_batch, case when event_id % 89 = 0 then null else ts end as t from events),
limits as (
  select b.micro_batch, (select max(t) from arrived a where a.micro_batch < b.micro_batch) - interval '30 minutes' as limit_time
  from (select distinct micro_batch from arrived) b),
audited as (
  select *, case when t is null then 'undated' when t < limit_time then 'late' else 'kept' end as fate from arrived join limits using (micro_batch))"""
AVAILABILITY = "with " + CLEANED + """
select "date", count(*) as observed_records, 4032::bigint as expected_records,
  round(count(*) / 4032::double + 1.2345e-8, 6) + 0.0 as availability_rate, 4032 - count(*) as missing_records,
  round(1 - count(*) / 4032::double + 1.2345e-8, 6) + 0.0 as missing_rate,
  case when count(*) <= 4032 then 'OK' else 'CHECK_OBSERVED_GT_EXPECTED' end as availability_check_flag
from cleaned group by "date" """
POINT_FLOWS = "with " + POINT_DOCS + """
select flow_id as uuid, 'A' || event_id::varchar as point_uuid, ts as capture_time,
  (case when event_id % 7 = 0 then 0 else 40 + event_id % 60 end)::int as current_speed, 90::int as free_flow_speed,
  (100 + event_id % 33)::int as current_travel_time, (case when event_id % 11 = 0 then 0 else 100 end)::int as free_flow_travel_time,
  case when event_id % 5 = 0 then 0.0::double else (event_id % 8) / 8.0::double end as confidence, event_id % 9 = 0 as road_closure
from docs where good"""

ORACLE: dict[str, str] = {
    "scan_events": "select event_id, ts, user_id, event_type, round(value + 1.2345e-8, 6) + 0.0 as value, props from events",
    "point_config": "with " + POINT_RAW + "," + CONFIG + """
select point_id, block_id, corridor_order, coalesce(n, 0)::bigint as raw_records
from config left join (select point_id, count(*) as n from point_raw group by 1) using (point_id)""",
    "normalize_columns": """
select user_id % 42 + 1 as point_id,
  case event_id % 5 when 0 then strftime(ts, '%Y/%m/%d %H:%M:%S') when 1 then strftime(ts, '%m/%d/%Y %H:%M')
    when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 3 then ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' else 'n.a.' end as "timestamp",
  case event_id % 7 when 0 then 'n/a' when 1 then '12f' when 2 then ' ' || (event_id % 90)::varchar || ' '
    when 3 then (event_id % 90)::varchar || '.5' when 4 then '-' || (event_id % 90)::varchar
    when 5 then 'NaN' else (event_id % 9)::varchar || 'e1' end as current_speed,
  (60 + event_id % 5)::varchar as free_flow_speed, (100 + event_id % 50)::varchar as current_travel_time, 100::int as "free travel time",
  case event_id % 6 when 0 then 'TRUE' when 1 then ' Road_Closed ' when 2 then 'open' when 3 then '1' when 4 then '' end as road_closure,
  event_id as ingest_seq
from events""".replace('100::int as "free travel time"', "100::int as free_flow_travel_time"),
    "parse_timestamps": "with " + MESSY + """
select event_id as ingest_seq, parsed, time_bucket(interval '15 minutes', parsed) as interval_15min,
  cast(time_bucket(interval '15 minutes', parsed) as date) as "date" from messy""",
    "floor_15min": "select event_id, time_bucket(interval '15 minutes', ts) as slot from events",
    "floor_30min": "select event_id, time_bucket(interval '30 minutes', ts) as slot from events",
    "coerce_numeric": """
select event_id as ingest_seq, (user_id % 42 + 1)::varchar as point_id,
  case event_id % 7 when 2 then (event_id % 90)::double when 3 then event_id % 90 + 0.5::double
    when 4 then -(event_id % 90)::double + 0.0 when 6 then (event_id % 9) * 10.0::double end as current_speed,
  (60 + event_id % 5)::double as free_flow_speed, (100 + event_id % 50)::double as current_travel_time, 100::double as free_flow_travel_time
from events""",
    "closure_flag": "select event_id as ingest_seq, event_id % 6 in (0, 1, 3) as road_closure_bool from events",
    "segment_to_block": "with " + SEGMENT_DOCS + """
select block_id, place_id, count(*) as n, round(sum(speed_kmh) + 1.2345e-8, 6) + 0.0 as speed_sum
from seg_flow left join places using (place_id) group by 1, 2""",
    "traffic_indicators": "with " + POINT_FLAGGED + """
select ingest_seq, round((free_flow_speed - current_speed) / free_flow_speed + 1.2345e-8, 6) + 0.0 as srr,
  round(current_travel_time / free_flow_travel_time + 1.2345e-8, 6) + 0.0 as tti,
  round(current_travel_time - free_flow_travel_time + 1.2345e-8, 6) + 0.0 as ett_seconds,
  round((current_travel_time - free_flow_travel_time) / free_flow_travel_time * 100 + 1.2345e-8, 6) + 0.0 as ci_percent,
  current_travel_time < free_flow_travel_time as ci_negative_flag
from point_valid""",
    "negative_ci_share": "with " + CLEANED + """
select "date", count(*) filter (where ci_negative_flag) as negative_records,
  round(count(*) filter (where ci_negative_flag) / count(*)::double + 1.2345e-8, 6) + 0.0 as negative_share from cleaned group by 1""",
    "ci_formula_check": "with " + CLEANED + """
select count(*) as cleaned_records, round(max(abs(ci_percent - ci_percent_from_tti)) + 1.2345e-8, 6) + 0.0 as max_ci_formula_abs_error,
  count(*) filter (where ci_negative_flag) as negative_ci_records,
  round(count(*) filter (where ci_negative_flag) / count(*)::double + 1.2345e-8, 6) + 0.0 as negative_ci_share from cleaned""",
    "quality_flags_point": "with " + POINT_FLAGGED + """
select ingest_seq, interval_15min, "date", valid_time, valid_core_fields, valid_speed, valid_travel_time, valid_closure, confidence_exists,
  valid_time and valid_core_fields and valid_speed and valid_travel_time and valid_closure as is_valid_base from point_flagged""",
    "quality_flags_segment": "with " + SEGMENT_FLAGGED + """
select ingest_seq, interval_30min, "date", valid_time, valid_core_fields, valid_speed, valid_jam_factor, confidence_exists,
  valid_time and valid_core_fields and valid_speed and valid_jam_factor as is_valid from segment_flagged""",
    "clean_point": "with " + CLEANED + f"""
select point_id, "timestamp", {_rs("current_speed", "free_flow_speed", "current_travel_time", "free_flow_travel_time", "confidence")},
  ingest_seq, interval_15min, "date", is_duplicate_removed, {_rs("srr", "tti", "ett_seconds", "ci_percent", "ci_percent_from_tti")},
  round(abs(ci_percent - ci_percent_from_tti) + 1.2345e-8, 6) + 0.0 as ci_formula_abs_error, ci_negative_flag
from cleaned""",
    "clean_point_strict": "with " + POINT_FLAGGED + f"""
select point_id, interval_15min, ingest_seq, {_rs("confidence")},
  round((current_travel_time - free_flow_travel_time) / free_flow_travel_time * 100 + 1.2345e-8, 6) + 0.0 as ci_percent
from (select *, row_number() over (partition by point_id, interval_15min order by "timestamp", ingest_seq) as n
      from point_flagged where valid_time and valid_core_fields and valid_speed and valid_travel_time and valid_closure and confidence_exists)
where n = 1""",
    "dedup_point_slot": DEDUP,
    "duplicate_log": "with " + POINT_FLAGGED + """
select point_id, interval_15min, "timestamp", ingest_seq, "date", true as is_duplicate_removed from point_valid where nth > 1""",
    "cleaning_log_point": "with " + POINT_FLAGGED + """,
outcome as (select "date", count(*) filter (where nth > 1) as dup, count(*) filter (where nth = 1) as kept from point_valid group by 1)
select l."date", raw_records, invalid_time_records, missing_core_field_records, non_positive_speed_records,
  non_positive_travel_time_records, closure_related_records, confidence_missing_records,
  coalesce(dup, 0)::bigint as duplicate_records, coalesce(kept, 0)::bigint as valid_records,
  round(coalesce(kept, 0) / raw_records::double + 1.2345e-8, 6) + 0.0 as cleaning_pass_rate
from (select "date", count(*) as raw_records, count(*) filter (where not valid_time) as invalid_time_records,
        count(*) filter (where not valid_core_fields) as missing_core_field_records,
        count(*) filter (where not valid_speed) as non_positive_speed_records,
        count(*) filter (where not valid_travel_time) as non_positive_travel_time_records,
        count(*) filter (where not valid_closure) as closure_related_records,
        count(*) filter (where not confidence_exists) as confidence_missing_records
      from point_flagged group by 1) l left join outcome o on l."date" is not distinct from o."date" """,
    "cleaning_log_segment": "with " + SEGMENT_FLAGGED + """
select "date", count(*) as raw_records, count(*) filter (where not valid_time) as invalid_time_records,
  count(*) filter (where not valid_core_fields) as missing_core_field_records,
  count(*) filter (where not valid_speed) as non_positive_speed_records,
  count(*) filter (where not valid_jam_factor) as negative_jam_factor_records,
  count(*) filter (where valid_time and valid_core_fields and valid_speed and valid_jam_factor) as valid_records,
  round(count(*) filter (where valid_time and valid_core_fields and valid_speed and valid_jam_factor) / count(*)::double + 1.2345e-8, 6) + 0.0 as cleaning_pass_rate
from segment_flagged group by 1""",
    "daily_availability": AVAILABILITY,
    "run_all": "with " + MATCHED + """
select table_name, n::bigint as row_count, n::bigint as rows_there from (values
  ('tomtom_cleaned_point_time', (select count(*) from cleaned)),
  ('tomtom_daily_availability', (select count(distinct "date") from cleaned)),
  ('tomtom_cleaning_log_by_date', (select count(*) from (select distinct "date" from point_flagged))),
  ('tomtom_duplicate_log', (select count(*) from point_valid where nth > 1)),
  ('here_cleaned_block_time', (select count(*) from segment_30)),
  ('here_cleaning_log_by_date', (select count(*) from (select distinct "date" from segment_flagged))),
  ('tomtom_block_30min', (select count(*) from block_30)),
  ('matched_tomtom_here_30min', (select count(*) from matched)),
  ('benchmark_summary', (select 1 + count(distinct block_id) from matched)),
  ('sensitivity_threshold', (select 4)),
  ('sensitivity_lag', (select 3)),
  ('sensitivity_per_block', (select count(distinct block_id) from matched)),
  ('sensitivity_daily', (select count(distinct "date") from matched)),
  ('fig5_intraday_profile_data', (select count(distinct strftime(interval_15min, '%H:%M')) from cleaned)),
  ('fig5_weekday_weekend_profile_data', (select count(distinct strftime(interval_15min, '%H:%M') || (isodow(interval_15min) <= 5)::varchar) from cleaned))) t(table_name, n)""",
    "run_updated": "with " + MATCHED + """
select 'tomtom_cleaning_log_by_date' as table_name, "date", count(*) as records, (select count(*) from cleaned c where c."date" is not distinct from p."date")::bigint as valid_records from point_flagged p group by "date"
union all select 'here_cleaning_log_by_date', "date", count(*), count(*) filter (where valid_time and valid_core_fields and valid_speed and valid_jam_factor) from segment_flagged group by "date"
union all select 'tomtom_duplicate_log', "date", count(*), null from point_valid where nth > 1 group by "date"
union all select 'matched_tomtom_here_30min', "date", count(*), null from matched group by "date" """,
    "describe_outputs": """
select * from (values
  ('point_id', 'string', null), ('timestamp', 'timestamp_ntz', null), ('current_speed', 'double', 'definition: speed of the probe; unit: km/h'),
  ('free_flow_speed', 'double', null), ('current_travel_time', 'double', null), ('free_flow_travel_time', 'double', null), ('confidence', 'double', null),
  ('ingest_seq', 'bigint', null), ('interval_15min', 'timestamp_ntz', null), ('date', 'date', null), ('is_duplicate_removed', 'boolean', null),
  ('srr', 'double', null), ('tti', 'double', null), ('ett_seconds', 'double', null),
  ('ci_percent', 'double', 'definition: extra travel time over free flow; note: largest input value ' || (select max(value) from events)::varchar || '; unit: %'),
  ('ci_percent_from_tti', 'double', null), ('ci_formula_abs_error', 'double', null), ('ci_negative_flag', 'boolean', null)) t(variable, type, description)""",
    "run_report": "with " + MATCHED + """
select 'point_raw' as table_name, count(*) as row_count from point_raw
union all select 'point_cleaned', count(*) from cleaned
union all select 'point_duplicates', count(*) from point_valid where nth > 1
union all select 'segment_raw', count(*) from segment_flagged
union all select 'segment_valid', count(*) from segment_valid
union all select 'matched', count(*) from matched""",
    "unassigned_points": "with " + CLEANED + "," + CONFIG + """
select distinct point_id from cleaned where point_id not in (select point_id from config where block_id = '1') order by 1""",
    "point_30min": "with " + BLOCK + f"""
select block_id, point_id, interval_30min, {_rs("tomtom_current_speed", "tomtom_free_flow_speed", "tomtom_current_travel_time", "tomtom_free_flow_travel_time", "tomtom_ci_percent", "tomtom_tti", "tomtom_srr", "tomtom_ett_seconds")},
  tomtom_15min_count from point_30""",
    "block_30min": "with " + BLOCK + f"""
select block_id, interval_30min, {_rs("tomtom_mean_current_speed", "tomtom_mean_free_flow_speed", "tomtom_mean_current_travel_time", "tomtom_mean_free_flow_travel_time", "tomtom_mean_ci_percent", "tomtom_median_ci_percent", "tomtom_mean_tti", "tomtom_mean_srr", "tomtom_mean_ett_seconds")},
  tomtom_point_count, tomtom_record_count_15min, "date" from block_30""",
    "block_30min_weighted": "with " + BLOCK + """
select block_id, interval_30min, round(sum(tomtom_ci_percent * w) / nullif(sum(w), 0) + 1.2345e-8, 6) + 0.0 as weighted_ci_percent,
  round(sum(tomtom_current_speed * w) / nullif(sum(w), 0) + 1.2345e-8, 6) + 0.0 as weighted_current_speed, round(sum(w) + 1.2345e-8, 6) + 0.0 as total_weight, count(*) filter (where w is null) as unweighted_points
from (select *, case when substr(point_id, 2)::int % 11 <> 0 then 1.0::double + (substr(point_id, 2)::int % 8) / 4.0::double end as w from point_30) group by 1, 2""",
    "unweighted_points": "with " + CLEANED + " select point_id, count(*) as records from cleaned where substr(point_id, 2)::int % 11 = 0 group by 1",
    "segment_block_time": "with " + SEGMENT_BLOCK + f"""
select block_id, interval_30min, {_rs("here_mean_speed", "here_median_speed", "here_mean_jam_factor", "here_median_jam_factor")},
  here_segment_count, here_record_count, {_rs("here_mean_confidence")}, "date" from segment_30""",
    "match_block_time": "with " + MATCHED + f"""
select block_id, interval_30min, {_rs("tomtom_mean_current_speed", "tomtom_mean_free_flow_speed", "tomtom_mean_current_travel_time", "tomtom_mean_free_flow_travel_time", "tomtom_mean_ci_percent", "tomtom_median_ci_percent", "tomtom_mean_tti", "tomtom_mean_srr", "tomtom_mean_ett_seconds")},
  tomtom_point_count, tomtom_record_count_15min, date_tomtom,
  {_rs("here_mean_speed", "here_median_speed", "here_mean_jam_factor", "here_median_jam_factor")},
  here_segment_count, here_record_count, {_rs("here_mean_confidence")}, date_here, "date" from matched""",
    "pearson_by_block": _correlation_by_block("pearson_r"),
    "spearman_by_block": _correlation_by_block("spearman_rho"),
    "peak_thresholds": "with " + MATCHED + """,
melted as (select 'tomtom_mean_ci_percent' as measure, x as v from matched union all select 'here_mean_jam_factor', y from matched)
select 'pooled' as unit, measure, count(*) as unit_n, round(quantile_cont(v, 0.8) + 1.2345e-8, 6) + 0.0 as q80, round(quantile_cont(v, 0.85) + 1.2345e-8, 6) + 0.0 as q85,
  round(quantile_cont(v, 0.9) + 1.2345e-8, 6) + 0.0 as q90, round(quantile_cont(v, 0.95) + 1.2345e-8, 6) + 0.0 as q95 from melted group by measure""",
    "peak_overlap": "with " + MATCHED + ", unit_rows as (select block_id as unit, x, y from matched)," + _stats("unit_rows")
    + " select unit as block_id, matched_n, " + _r("overlap_0", "peak_overlap_index") + " from stats",
    "benchmark_summary": "with " + MATCHED
    + ", unit_rows as (select 'pooled' as unit, x, y from matched union all select 'block_' || block_id, x, y from matched),"
    + _stats("unit_rows") + f" select {SUMMARY_COLUMNS} from stats",
    "sensitivity_threshold": "with " + MATCHED + ", unit_rows as (select 'pooled' as unit, x, y from matched),"
    + _stats("unit_rows", (0.80, 0.85, 0.90, 0.95))
    + " union all ".join(
        f" select {q}::double as threshold_quantile, matched_n, {_r(f'overlap_{i}', 'peak_overlap_index')} from stats"
        for i, q in enumerate((0.80, 0.85, 0.90, 0.95))
    ),
    "sensitivity_lag": "with " + MATCHED + """,
unit_rows as (
  select lag as unit, a.x, b.y
  from (select distinct block_id, interval_30min, x from matched) a, (values (-30), (0), (30)) l(lag),
       (select distinct block_id, interval_30min, y from matched) b
  where a.block_id = b.block_id and a.interval_30min = b.interval_30min + to_minutes(lag)),"""
    + _stats("unit_rows")
    + f" select unit::int as here_shift_minutes, matched_n, {_rs('pearson_r', 'spearman_rho')}, 0.85::double as peak_overlap_q, "
    + _r("overlap_0", "peak_overlap_index") + " from stats",
    "sensitivity_per_block": _unit_table("block_id"),
    "sensitivity_daily": _unit_table('"date"'),
    "release_checks": "with " + MATCHED + """
select "check", round(value + 1.2345e-8, 6) + 0.0 as value, round(threshold + 1.2345e-8, 6) + 0.0 as threshold, ok from (
  select 'max_daily_observed' as "check", max(n)::double as value, 4032::double as threshold, max(n) <= 4032 as ok
  from (select count(*) as n from cleaned group by "date")
  union all select 'max_ci_formula_error', max(abs(ci_percent - ci_percent_from_tti)), 1e-9, max(abs(ci_percent - ci_percent_from_tti)) <= 1e-9 from cleaned
  union all select 'negative_ci_share', avg(ci_negative_flag::int), 0.5, avg(ci_negative_flag::int) <= 0.5 from cleaned
  union all select 'matched_pooled', count(*), 3, count(*) >= 3 from matched
  union all select 'matched_block_' || block_id, count(*), 3, count(*) >= 3 from matched group by block_id)""",
    "intraday_profile": "with " + CLEANED + """
select strftime(interval_15min, '%H:%M') as time_of_day, round(avg(current_speed) + 1.2345e-8, 6) + 0.0 as mean_current_speed,
  round(avg(ci_percent) + 1.2345e-8, 6) + 0.0 as mean_ci_percent, round(avg(tti) + 1.2345e-8, 6) + 0.0 as mean_tti, round(avg(srr) + 1.2345e-8, 6) + 0.0 as mean_srr,
  count(*) as record_count from cleaned group by 1""",
    "day_type_profile": "with " + CLEANED + """
select strftime(interval_15min, '%H:%M') as time_of_day, case when isodow(interval_15min) <= 5 then 'weekday' else 'weekend' end as day_type,
  round(avg(current_speed) + 1.2345e-8, 6) + 0.0 as mean_current_speed, round(avg(ci_percent) + 1.2345e-8, 6) + 0.0 as mean_ci_percent,
  round(avg(tti) + 1.2345e-8, 6) + 0.0 as mean_tti, count(*) as record_count from cleaned group by 1, 2""",
    "profile_zscore": "with " + CLEANED + f""",
profile as (
  select strftime(interval_15min, '%H:%M') as time_of_day, avg(current_speed) as mean_current_speed, avg(ci_percent) as mean_ci_percent,
    avg(tti) as mean_tti, avg(srr) as mean_srr, count(*) as record_count from cleaned group by 1)
select time_of_day, {_rs("mean_current_speed", "mean_ci_percent", "mean_tti", "mean_srr")}, record_count,
  round((mean_ci_percent - avg(mean_ci_percent) over ()) / nullif(stddev_samp(mean_ci_percent) over (), 0) + 1.2345e-8, 6) + 0.0 as z_ci_percent,
  round((mean_tti - avg(mean_tti) over ()) / nullif(stddev_samp(mean_tti) over (), 0) + 1.2345e-8, 6) + 0.0 as z_tti
from profile""",
    "moving_average": "with " + CLEANED + """
select point_id, interval_15min, round(ci_percent + 1.2345e-8, 6) + 0.0 as ci_percent,
  round(avg(ci_percent) over (partition by point_id order by interval_15min rows between 3 preceding and current row) + 1.2345e-8, 6) + 0.0 as mean_last_records,
  round(avg(ci_percent) over (partition by point_id order by interval_15min range between interval '45 minutes' preceding and current row) + 1.2345e-8, 6) + 0.0 as mean_time_span
from cleaned""",
    "ingest_point_json": POINT_FLOWS,
    "ingest_point_coords": "with " + POINT_DOCS + """
select flow_id as flow_uuid, 1.0::double + i / 64.0::double as latitude, round(110.0::double + event_id / 1048576.0::double + 1.2345e-8, 6) + 0.0 as longitude,
  i::int as sequence_order from docs, range(1, 5) t(i) where good and i <= event_id % 4""",
    "ingest_segment_json": "with " + SEGMENT_DOCS + f"""
select uuid, bbox_uuid, batch_id, place_id, capture_time, road_name, number_roads, {_rs("speed_kmh", "jam_factor")} from seg_flow""",
    "ingest_segment_shape": "with " + SEGMENT_DOCS + f"""
select flow_uuid, {_rs("latitude", "longitude")}, functional_class, all_description_str, all_length, zl_length, sequence_order from seg_shape""",
    "ingest_rejects": """
select 'point' as feed, 'A' || event_id::varchar as doc_id,
  case when event_id % 37 = 0 then 'unparseable' when event_id % 41 = 0 then 'no_flow_segment' when event_id % 43 = 0 then 'no_coordinates' else 'bad_number' end as reject_reason
from events where event_id % 37 = 0 or event_id % 41 = 0 or event_id % 43 = 0 or event_id % 47 = 0
union all
select distinct 'segment', 'B' || (event_id // 10)::varchar, case when (event_id // 10) % 58 = 0 then 'no_results' else 'unparseable' end
from events where (event_id // 10) % 29 = 0""",
    "ingested_segment_grid": "with " + SEGMENT_DOCS + """
select block_id, time_bucket(interval '30 minutes', capture_time) as interval_30min, round(avg(speed_kmh) + 1.2345e-8, 6) + 0.0 as here_mean_speed,
  round(median(jam_factor) + 1.2345e-8, 6) + 0.0 as here_median_jam_factor, count(distinct road_name) as here_segment_count, count(*) as here_record_count
from seg_flow join places using (place_id) where speed_kmh > 0 and jam_factor >= 0 group by 1, 2""",
    "segment_geometry": "with " + SEGMENT_DOCS + """
select f.uuid, count(*)::int as path_points, string_agg(sequence_order::varchar, ',' order by sequence_order) as path_order,
  round(arg_min(longitude, sequence_order) + 1.2345e-8, 6) + 0.0 as first_longitude, round(arg_max(latitude, sequence_order) + 1.2345e-8, 6) + 0.0 as last_latitude
from seg_flow f join seg_shape s on f.bbox_uuid = s.flow_uuid group by f.uuid""",
    "flow_to_point": "with " + TRACED + """
select uuid, point_uuid, pd_uuid, point_id, capture_time, current_speed from traced where link = 'linked'""",
    "unlinked_flows": "with " + TRACED + """
select uuid, point_uuid, link from traced where link <> 'linked'""",
    "lineage_report": "with " + TRACED + """
select link, count(*) as flows, count(distinct cast(capture_time as date)) as days, min(capture_time) as first_capture, max(capture_time) as last_capture from traced group by 1""",
    "points_in_bbox": """
with boxes as (
  select 'Box ' || s_suppkey::varchar as name,
    cast(cast(110 + s_suppkey * 0.1 as decimal(9,2)) as double) as x0, cast(cast(1 + s_suppkey % 7 * 0.05 as decimal(5,2)) as double) as y0,
    cast(cast(110.15 + s_suppkey * 0.1 as decimal(9,2)) as double) as x1, cast(cast(1.08 + s_suppkey % 7 * 0.05 as decimal(5,2)) as double) as y1
  from supplier
  union all select 'Region ' || s_suppkey::varchar, 110 + s_suppkey // 10, 1, 112 + s_suppkey // 10, 1.25 from supplier where s_suppkey % 10 = 0
  union all select 'Street ' || s_suppkey::varchar, 110 + s_suppkey, 1, ((110 + s_suppkey)::varchar || '.0001')::double, 1.5 from supplier where s_suppkey % 3 = 0
  union all select 'Country', 100, 0, 900, 7 from supplier where s_suppkey = 1),
pos as (select event_id, 1.0::double + (event_id % 512) / 1024.0::double as lat, 110.0::double + event_id / 1000.0::double as lon from events)
select event_id, name from pos join boxes on lon between x0 and x1 and lat between y0 and y1""",
    "unusable_boxes": """
select 'Unread ' || s_suppkey::varchar as name, case when s_suppkey % 100 = 0 then 'everywhere' else '111,2,110,1' end as bbox from supplier where s_suppkey % 50 = 0""",
    "segment_to_block_by_position": "with " + SEGMENT_DOCS + """,
boxes as (
  select case when s_suppkey = 1 then 'rest' else 'B' || s_suppkey::varchar end as name,
    case when s_suppkey = 1 then 109 else 110 + (s_suppkey - 2) / 64.0::double end as x0, case when s_suppkey = 1 then 0 else 1 end as y0,
    case when s_suppkey = 1 then 115 else 110 + (s_suppkey - 1) / 64.0::double end as x1, case when s_suppkey = 1 then 1.03125::double else 1.5 end as y1
  from supplier where s_suppkey = 1 or s_suppkey % 5 <> 0),
starts as (select flow_uuid as bbox_uuid, arg_min(latitude, sequence_order) as lat, arg_min(longitude, sequence_order) as lon from seg_shape group by 1)
select s.bbox_uuid, arg_min(name, ((x1 - x0) * (y1 - y0), name)) as block_id
from starts s left join boxes on lon between x0 and x1 and lat between y0 and y1 group by 1""",
    "round_robin_assign": _deal(
        "platform = 'TOMTOM'", "", "md5('run-1#' || uuid) as uuid, 'run-1' as pd_uuid, key_number, uuid as point_uuid, latitude, longitude",
        "md5(uuid || '#7')",
    ),
    "ordered_assign": _deal("platform = 'TOMTOM'", "", "md5('run-1#' || uuid) as uuid, 'run-1' as pd_uuid, key_number, uuid as point_uuid"),
    "ordered_assign_filtered": _deal("true", "where platform = 'TOMTOM'", "key_number, uuid as point_uuid"),
    "assignment_balance": "with " + ASSIGNED + """
select pd_uuid, sum(n)::bigint as assigned_points, count(*) as used_keys, min(n) as min_per_key, max(n) as max_per_key, (50 - sum(n))::bigint as lost_points
from (select pd_uuid, key_number, count(*) as n from assigned group by 1, 2) group by 1""",
    "run_completeness": "with " + ASSIGNED + """
select pd_uuid, count(*) as planned_points, count(*) filter (where met) as captured_points,
  count(*) filter (where not met) as missing_points, round(count(*) filter (where met) / count(*)::double + 1.2345e-8, 6) + 0.0 as captured_share
from (select *, captured and o_orderkey % 83 <> 0 as met from assigned) group by 1""",
    "key_usage_daily": "with " + USAGE + " select * from usage",
    "key_usage_dense": "with " + USAGE + """,
days as (select unnest(generate_series((select min(usage_date) from usage), (select max(usage_date) from usage), interval 1 day))::date as usage_date)
select k.uuid as api_key_uuid, d.usage_date, coalesce(request_count, 0)::bigint as request_count, coalesce(error_count, 0)::bigint as error_count
from keys k cross join days d left join usage u on u.api_key_uuid = k.uuid and u.usage_date = d.usage_date""",
    "key_quota_use": "with " + USAGE + """,
running as (
  select *, sum(request_count) over (partition by api_key_uuid, date_trunc('month', usage_date) order by usage_date)::bigint as month_requests from usage)
select api_key_uuid, usage_date, request_count, month_requests, round(request_count / daily_limit::double + 1.2345e-8, 6) + 0.0 as daily_use,
  round(month_requests / monthly_limit::double + 1.2345e-8, 6) + 0.0 as monthly_use, request_count > daily_limit or month_requests > monthly_limit as over_limit
from running join keys on uuid = api_key_uuid""",
    "latest_failed_job": "with " + JOBS + " select uuid, job_name, start_time, end_time, status from jobs where status = 'FAILED' order by end_time desc, uuid limit 1",
    "current_job_state": "with " + JOBS + " select * from jobs",
    "job_run_summary": "with " + JOBS + """
select job_name, cast(start_time as date) as "date", count(*) as runs, count(*) filter (where status = 'SUCCESS') as succeeded,
  count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'RUNNING') as still_running,
  round(avg((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0::double) + 1.2345e-8, 6) + 0.0 as mean_seconds,
  sum(total_points)::bigint as total_points, sum(success_points)::bigint as success_points,
  round(sum(success_points)::double / nullif(sum(total_points), 0)::double + 1.2345e-8, 6) + 0.0 as success_ratio
from jobs group by 1, 2""",
    "heartbeat_outages": OUTAGES,
    "weekly_distribution": "with " + CLEANED + """
select (isodow(interval_15min) - 1)::int as weekday, hour(interval_15min)::int as hour, round(avg(ci_percent) + 1.2345e-8, 6) + 0.0 as mean_ci_percent,
  count(*) as record_count, round(median(ci_percent) + 1.2345e-8, 6) + 0.0 as median_ci_percent from cleaned group by 1, 2""",
    "weekly_heatmap": "with " + CLEANED + " select hour(interval_15min)::int as hour, " + ", ".join(
        f"round(avg(ci_percent) filter (where isodow(interval_15min) = {i + 1}) + 1.2345e-8, 6) + 0.0 as day_{i}" for i in range(7)
    ) + " from cleaned group by 1",
    "monthly_trend": "with " + CLEANED + """
select cast(date_trunc('month', interval_15min) as date) as month, count(*) as record_count, round(min(ci_percent) + 1.2345e-8, 6) + 0.0 as min_ci_percent,
  round(avg(ci_percent) + 1.2345e-8, 6) + 0.0 as mean_ci_percent, round(max(ci_percent) + 1.2345e-8, 6) + 0.0 as max_ci_percent,
  round(stddev_samp(ci_percent) + 1.2345e-8, 6) + 0.0 as sd_ci_percent, round(avg(current_speed) + 1.2345e-8, 6) + 0.0 as mean_current_speed from cleaned group by 1""",
    "daily_fluctuation": "with " + CLEANED + """
select "date", count(*) as record_count, round(min(ci_percent) + 1.2345e-8, 6) + 0.0 as min_ci_percent, round(avg(ci_percent) + 1.2345e-8, 6) + 0.0 as mean_ci_percent,
  round(max(ci_percent) + 1.2345e-8, 6) + 0.0 as max_ci_percent, round(stddev_samp(ci_percent) + 1.2345e-8, 6) + 0.0 as sd_ci_percent from cleaned group by 1""",
    "boxplot_stats": "with " + CLEANED + """,
typed as (select case when isodow(interval_15min) <= 5 then 'weekday' else 'weekend' end as day_type, ci_percent as v from cleaned),
five as (
  select day_type, count(*) as n, min(v) as minimum, quantile_cont(v, 0.25) as q1, median(v) as median, quantile_cont(v, 0.75) as q3, max(v) as maximum
  from typed group by 1),
fenced as (select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from five)
select day_type, n, round(minimum + 1.2345e-8, 6) + 0.0 as minimum, round(q1 + 1.2345e-8, 6) + 0.0 as q1, round(median + 1.2345e-8, 6) + 0.0 as median, round(q3 + 1.2345e-8, 6) + 0.0 as q3,
  round(maximum + 1.2345e-8, 6) + 0.0 as maximum, round(lower_fence + 1.2345e-8, 6) + 0.0 as lower_fence, round(upper_fence + 1.2345e-8, 6) + 0.0 as upper_fence,
  round(min(v) filter (where v between lower_fence and upper_fence) + 1.2345e-8, 6) + 0.0 as lower_whisker,
  round(max(v) filter (where v between lower_fence and upper_fence) + 1.2345e-8, 6) + 0.0 as upper_whisker,
  count(*) filter (where v not between lower_fence and upper_fence) as outliers
from fenced join typed using (day_type) group by all""",
    "impact_comparison": "with " + CLEANED + """,
m as (
  select count(*) filter (where a) as na, count(*) filter (where not a) as nn, avg(ci_percent) filter (where a) as ma, avg(ci_percent) filter (where not a) as mn,
    var_samp(ci_percent) filter (where a) as va, var_samp(ci_percent) filter (where not a) as vn
  from (select *, day("date") % 4 = 0 as a from cleaned))
select na as affected_n, nn as normal_n, round(ma + 1.2345e-8, 6) + 0.0 as affected_mean, round(mn + 1.2345e-8, 6) + 0.0 as normal_mean, round(ma - mn + 1.2345e-8, 6) + 0.0 as difference,
  round(ma / nullif(mn, 0) + 1.2345e-8, 6) + 0.0 as ratio, round((ma - mn) / nullif(sqrt(va / na + vn / nn), 0) + 1.2345e-8, 6) + 0.0 as welch_t from m""",
    "hotspot_topk": "with " + CLEANED + """
select point_id, count(*) as record_count, count(*) filter (where ci_percent >= t) as high_count,
  round(count(*) filter (where ci_percent >= t) / count(*)::double + 1.2345e-8, 6) + 0.0 as high_share
from cleaned, (select quantile_cont(ci_percent, 0.85) as t from cleaned)
group by point_id order by count(*) filter (where ci_percent >= t) / count(*)::double desc, point_id limit 10""",
    "segment_speed_profile": "with " + CLEANED + "," + CONFIG + """,
means as (
  select block_id, point_id, corridor_order, avg(current_speed) as v, avg(ci_percent) as c from cleaned join config using (point_id) group by all)
select block_id, point_id, corridor_order, round(v + 1.2345e-8, 6) + 0.0 as mean_current_speed, round(c + 1.2345e-8, 6) + 0.0 as mean_ci_percent,
  round(lag(v) over (partition by block_id order by corridor_order) - v + 1.2345e-8, 6) + 0.0 as speed_drop from means""",
    "functional_class_compare": "with " + SEGMENT_DOCS + """
select functional_class, count(*) as flow_count, round(avg(speed_kmh) + 1.2345e-8, 6) + 0.0 as mean_speed, round(avg(jam_factor) + 1.2345e-8, 6) + 0.0 as mean_jam_factor,
  round(max(jam_factor) + 1.2345e-8, 6) + 0.0 as max_jam_factor
from seg_flow f join (select distinct flow_uuid, functional_class from seg_shape) s on f.bbox_uuid = s.flow_uuid group by 1""",
    "time_space_matrix": "with " + CLEANED + " select time_bucket(interval '30 minutes', interval_15min) as interval_30min, " + ", ".join(
        f"round(avg(current_speed) filter (where point_id = 'P{n:02d}') + 1.2345e-8, 6) + 0.0 as P{n:02d}" for n in range(1, 43)
    ) + " from cleaned group by 1",
    "time_space_long": "with " + CLEANED + "," + CONFIG + """
select time_bucket(interval '30 minutes', interval_15min) as interval_30min, point_id, round(avg(current_speed) + 1.2345e-8, 6) + 0.0 as mean_current_speed,
  round(avg(ci_percent) + 1.2345e-8, 6) + 0.0 as mean_ci_percent, corridor_order from cleaned join config using (point_id) group by all""",
    "impact_tests": "with " + CLEANED + """,
labelled as (select ci_percent as v, day("date") % 4 = 0 as a from cleaned where ci_percent is not null),
m as (
  select count(*) filter (where a)::double as na, count(*) filter (where not a)::double as nb, avg(v) filter (where a) as ma, avg(v) filter (where not a) as mb,
    var_samp(v) filter (where a) / count(*) filter (where a) as ea, var_samp(v) filter (where not a) / count(*) filter (where not a) as eb from labelled),
w as (select *, (ma - mb) / sqrt(ea + eb) as t, (ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) as df from m),
ranks as (select a, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double as r, count(*) over (partition by v)::double as e from labelled),
s as (select sum(r) filter (where a) as ra, sum(e * e - 1) as ties from ranks),
u as (select w.*, ra - na * (na + 1) / 2 as u, ties from w, s),
z as (select *, (u - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) as z from u),
grid as (select i / 4000.0::double as x, case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end as k from range(0, 4001) t(i))
select na::bigint as affected_n, nb::bigint as normal_n, round(t + 1.2345e-8, 6) + 0.0 as welch_t, round(df + 1.2345e-8, 6) + 0.0 as welch_df,
  round(1 - 2 * sum(k * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2 - (df + 1) / 2 * ln(1 + x * x * t * t / df))) * abs(t) / 12000 + 1.2345e-8, 6) + 0.0 as welch_p,
  round(u + 1.2345e-8, 6) + 0.0 as rank_sum_u, round(z + 1.2345e-8, 6) + 0.0 as rank_sum_z,
  round(1 - 2 * sum(k * exp(-x * x * z * z / 2)) / sqrt(2 * pi()) * abs(z) / 12000 + 1.2345e-8, 6) + 0.0 as rank_sum_p
from z, grid group by na, nb, t, df, u, z""",
    "bottlenecks": "with " + CLEANED + "," + CONFIG + """,
cells as (select block_id, point_id, corridor_order as place, time_bucket(interval '30 minutes', interval_15min) as slot, avg(ci_percent) as ci from cleaned join config using (point_id) group by all),
high as (select * from cells where ci >= (select quantile_cont(ci, 0.85) from cells)),
runs as (select *, place - row_number() over (partition by block_id, slot order by place) as run from high),
stretches as (select block_id, slot, arg_max(point_id, place) as head, count(*) as extent, sum(ci) as ci_sum from runs group by block_id, slot, run),
stands as (select *, epoch(slot)::bigint // 1800 - row_number() over (partition by block_id, head order by slot) as stand from stretches)
select block_id, head as head_point_id, min(slot) as first_slot, max(slot) as last_slot, count(*) * 30 as minutes, max(extent) as max_extent,
  round(avg(extent) + 1.2345e-8, 6) + 0.0 as mean_extent, round(sum(ci_sum) / sum(extent) + 1.2345e-8, 6) + 0.0 as mean_ci_percent
from stands group by block_id, head, stand""",
    "peak_spreading": "with " + SPREADING + "select * from spreading",
    "weekly_spreading": "with " + SPREADING + """,
weeks as (
  select cast(date_trunc('week', "date") as date) as week, count(*) as days, sum(peak_slots)::bigint as peak_slots, max(longest_slots) as longest_slots,
    avg(longest_slots) as mean_longest_slots, avg(hour(longest_start) * 60 + minute(longest_start)) as mean_start_minute from spreading group by 1)
select week, days, peak_slots, longest_slots, round(mean_longest_slots + 1.2345e-8, 6) + 0.0 as mean_longest_slots, round(mean_start_minute + 1.2345e-8, 6) + 0.0 as mean_start_minute,
  round(mean_longest_slots - lag(mean_longest_slots) over (order by week) + 1.2345e-8, 6) + 0.0 as spreading_slots,
  round(mean_start_minute - lag(mean_start_minute) over (order by week) + 1.2345e-8, 6) + 0.0 as shift_minutes from weeks""",
    "peak_hour_shift": "with " + CLEANED + """,
hourly as (select "date", hour(interval_15min)::int as hour, avg(ci_percent) as c from cleaned group by 1, 2),
tops as (select "date", max(c) as top from hourly group by 1),
limits as (select "date", top, (select quantile_cont(c, 0.85) from hourly) as t from tops)
select "date", min(hour) filter (where c = top) as peak_hour, round(max(c) + 1.2345e-8, 6) + 0.0 as peak_mean_ci, count(*) filter (where c >= t) as hours_at_peak
from hourly join limits using ("date") group by 1""",
    "stream_ingest": POINT_FLOWS,
    "stream_dedup": DEDUP,
    "stream_block_time": STREAM_SEGMENT,
    "stream_availability": AVAILABILITY,
    "stream_heartbeat": OUTAGES,
    "stream_running_availability": AVAILABILITY,
    "stream_window_audit": AUDIT + """
select micro_batch, count(*) as arrived, count(*) filter (where fate = 'kept') as kept, count(*) filter (where fate = 'late') as late,
  count(*) filter (where fate = 'undated') as undated, max(t) as newest, any_value(limit_time) as limit_time from audited group by 1""",
    "stream_aside": AUDIT + """
select micro_batch, fate, count(*) as records, min(event_id) as first_seq, sum(event_id)::bigint as seq_sum from audited where fate <> 'kept' group by 1, 2""",
    "stream_windows_in_order": STREAM_SEGMENT,
    "stream_outages": OUTAGES,
    "stream_open_outages": """
select event_type as job_name, max(ts) as last_beat, max(ts) + interval '15 minutes' as alert_at from events where event_type <> 'error' group by 1""",
}

# Streams into tables give what the batch forms give.
ORACLE |= {
    "stream_point_flows": ORACLE["stream_ingest"],
    "stream_point_shapes": ORACLE["ingest_point_coords"],
    "stream_segment_flows": ORACLE["ingest_segment_json"],
    "stream_segment_shapes": ORACLE["ingest_segment_shape"],
    "stream_point_rejects": f"select * from ({ORACLE['ingest_rejects']}) where feed = 'point'",
    "stream_segment_rejects": f"select * from ({ORACLE['ingest_rejects']}) where feed = 'segment'",
}
