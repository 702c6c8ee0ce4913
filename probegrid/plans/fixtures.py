"""Feeds and operations tables derived from the given tables.

No vendor data can be shipped, so every feed is a deterministic function of
``events``, ``customer``, ``nation`` or ``supplier``. The defects (bad times,
missing or zero values, closures, broken payloads) follow from the row id.
Each derivation is one scan and projection, so filters and column pruning
reach the Parquet reader.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from probegrid.schema import ENVELOPE_TIME
from probegrid.session import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_raw_of(table(spark, sf_dir, "events"))


def point_raw_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "'P' || lpad(cast(user_id % 42 + 1 as string), 2, '0') point_id",
        "case when event_id % 97 = 0 then 'not-a-time' else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end `timestamp`",
        """case when event_id % 61 = 0 then null when event_id % 53 = 0 then 0.0D
                when event_id % 59 = 0 then -1.0D
                else 60.0D + (user_id % 5) * 10 - value / 12 end current_speed""",
        "60.0D + (user_id % 5) * 10 free_flow_speed",
        """case when event_id % 67 = 0 then 0.0D
                else 95.0D + (user_id % 7) * 10 + value / 3 end current_travel_time""",
        "100.0D + (user_id % 7) * 10 free_flow_travel_time",
        "case when event_id % 11 = 0 then null else 0.5D + (event_id % 50) / 100.0D end confidence",
        """case when event_id % 101 = 0 then 'Closed' when event_id % 103 = 0 then ' YES '
                when event_id % 2 = 0 then '0' else null end road_closure""",
        "event_id ingest_seq",
    )


def segment_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_raw_of(table(spark, sf_dir, "events"))


def segment_raw_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "cast(1 + event_id % 3 as string) block_id",
        "case when event_id % 89 = 0 then null else ts end `timestamp`",
        """case when event_id % 43 = 0 then 0.0D when event_id % 73 = 0 then null
                else 80.0D - value / 12 end speed""",
        "case when event_id % 47 = 0 then -1.0D else value / 60 end jam_factor",
        "case when event_id % 17 = 0 then null else 0.25D + (event_id % 3) / 4.0D end confidence",
        "case when event_id % 13 = 0 then null else 'S' || cast(user_id % 20 as string) end segment_id",
        "event_id ingest_seq",
    )


def messy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point feed as an export might name and type it: aliases, text numbers."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 42 + 1 `Station-ID`",
        """case event_id % 5
             when 0 then date_format(ts, 'yyyy/MM/dd HH:mm:ss')
             when 1 then date_format(ts, 'MM/dd/yyyy HH:mm')
             when 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
             when 3 then ' ' || date_format(ts, 'yyyy-MM-dd HH:mm:ss') || ' '
             else 'n.a.' end `Collect Time`""",
        """case event_id % 7 when 0 then 'n/a' when 1 then '12f' when 2 then ' ' || cast(event_id % 90 as string) || ' '
             when 3 then cast(event_id % 90 as string) || '.5' when 4 then '-' || cast(event_id % 90 as string)
             when 5 then 'NaN' else cast(event_id % 9 as string) || 'e1' end currentSpeed""",
        "cast(60 + event_id % 5 as string) V_FF",
        "cast(100 + event_id % 50 as string) tt_cur",
        "100 `free travel time`",
        "case event_id % 6 when 0 then 'TRUE' when 1 then ' Road_Closed ' when 2 then 'open' when 3 then '1' when 4 then '' else null end is_closed",
        "event_id ingest_seq",
    )


def point_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point-feed document per event; some broken, some incomplete."""
    return table(spark, sf_dir, "events").selectExpr(
        "'A' || cast(event_id as string) point_uuid",
        "ts capture_time",
        """case
             when event_id % 37 = 0 then '{"flowSegmentData": {"currentSpeed": 1'
             when event_id % 41 = 0 then '{"detail": "no data"}'
             else to_json(named_struct('flowSegmentData', named_struct(
               'currentSpeed', case when event_id % 47 = 0 then element_at(array('99999999999', 'NaN', 'fast'), cast(1 + event_id % 3 as int))
                                    when event_id % 7 = 0 then null else cast(40 + event_id % 60 as string) end,
               'freeFlowSpeed', cast(90 as int),
               'currentTravelTime', cast(100 + event_id % 33 as int),
               'freeFlowTravelTime', case when event_id % 11 = 0 then null else cast(100 as int) end,
               'confidence', case when event_id % 5 = 0 then null else (event_id % 8) / 8.0D end,
               'roadClosure', case when event_id % 9 = 0 then true when event_id % 9 = 1 then false else null end,
               'coordinates', case when event_id % 43 = 0 then null else named_struct('coordinate',
                 transform(filter(sequence(1, 4), k -> k <= event_id % 4), i -> named_struct(
                   'latitude', 1.0D + i / 64, 'longitude', 110.0D + event_id / 1048576))) end)))
           end js""",
    )


def segment_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment-feed document per ten events; the position in it is the event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 10 batch_no",
        "event_id",
        "ts",
        """named_struct(
             'location', named_struct(
               'description', 'Road ' || cast(user_id % 20 as string), 'length', cast(100 + event_id % 50 as int),
               'shape', named_struct('links', transform(sequence(1, cast(1 + event_id % 3 as int)), l -> named_struct(
                 'length', cast(10 * l as int), 'functionalClass', cast(1 + (event_id + l) % 5 as int),
                 'points', transform(sequence(1, cast(2 + event_id % 2 as int)), p -> named_struct(
                   'lat', 1.0D + l / 64, 'lng', 110.0D + p / 64 + event_id / 1048576)))))),
             'currentFlow', case when event_id % 19 = 0 then null
                                 else named_struct('speed', 80.0D - value / 12, 'jamFactor', value / 60) end) result""",
    ).groupBy("batch_no").agg(
        # Ten events at most make one document.
        F.array_sort(F.collect_list(F.struct("event_id", "result"))).alias("parts"),
        F.min("ts").alias("capture_time"),
    ).select(
        F.expr("'B' || cast(batch_no as string)").alias("batch_id"),
        F.expr("'place ' || cast(batch_no % 12 as string)").alias("place_id"),
        "capture_time",
        F.expr("""case when batch_no % 58 = 0 then '{"results": []}' when batch_no % 29 = 0 then '{"results": ['
                       else to_json(named_struct('results', transform(parts, p -> p.result))) end""").alias("js"),
    )


def place_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block each scanned place belongs to, from the places observed."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr("cast(event_id div 10 % 12 as int) n")
        .distinct()
        .selectExpr("'place ' || cast(n as string) place_id", "cast(1 + n % 3 as string) block_id")
    )


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "'J' || cast(event_id as string) uuid",
        "event_type job_name",
        "ts start_time",
        "case when event_id % 71 = 0 then null else ts + make_dt_interval(0, 0, 0, 30 + event_id % 600) end end_time",
        """case when event_id % 71 = 0 then 'RUNNING' when event_type = 'error' or event_id % 23 = 0
                then 'FAILED' else 'SUCCESS' end status""",
        "case when event_id % 3 = 0 then null else cast(42 as int) end total_points",
        "case when event_id % 3 = 0 then null else cast(42 - event_id % 5 as int) end success_points",
        "case when event_type = 'error' then 'call failed' end error_message",
        "user_id",
    )


def job_log_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a change stream: a RUNNING row, later the final one."""
    logs = job_logs(spark, sf_dir)
    opened = logs.selectExpr("uuid", "job_name", "start_time", "cast(null as timestamp_ntz) end_time", "'RUNNING' status", "total_points", "success_points", "start_time changed_at")
    closed = logs.where("status <> 'RUNNING'").selectExpr("uuid", "job_name", "start_time", "end_time", "status", "total_points", "success_points", "end_time changed_at")
    return opened.unionByName(closed)


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeats_of(table(spark, sf_dir, "events"))


def heartbeats_of(events: DataFrame) -> DataFrame:
    return events.where("event_type <> 'error'").selectExpr("event_type job_name", "ts")


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per nation; every fifth is for the other platform."""
    return table(spark, sf_dir, "nation").selectExpr(
        "'K' || lpad(cast(n_nationkey as string), 2, '0') uuid",
        "case when n_nationkey % 5 < 4 then 'TOMTOM' else 'HERE' end platform",
        "cast(10 + n_nationkey as int) daily_limit",
        "cast(300 + 10 * n_nationkey as int) monthly_limit",
    )


def key_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which key each run used, and whether the run failed; five keys stay idle."""
    return table(spark, sf_dir, "events").selectExpr(
        "'K' || lpad(cast(user_id % 20 as string), 2, '0') api_key_uuid",
        "ts run_time",
        "event_type = 'error' failed",
    )


def monitor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monitoring point per customer, at a place of its own."""
    return table(spark, sf_dir, "customer").selectExpr(
        "'M' || cast(c_custkey as string) uuid",
        "'Site ' || cast(c_custkey as string) original_id",
        "cast(1 + c_custkey div 1000 * 0.001 as decimal(10,7)) latitude",
        "cast(110 + c_custkey % 1000 * 0.001 as decimal(10,7)) longitude",
        "c_custkey",
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment per order: a run (pd_uuid) of fifty and a customer's point; every 71st was moved off its point."""
    return table(spark, sf_dir, "orders").selectExpr(
        "'O' || cast(o_orderkey as string) uuid",
        "'R' || cast(o_orderkey div 50 as string) pd_uuid",
        "'K' || lpad(cast(o_orderkey % 20 as string), 2, '0') key_number",
        "cast(1 + o_custkey div 1000 * 0.001 + case when o_orderkey % 71 = 0 then 0.0005 else 0 end as decimal(10,7)) latitude",
        "cast(110 + o_custkey % 1000 * 0.001 as decimal(10,7)) longitude",
    )


def assigned_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow rows the assignments led to; each run stops early now and then."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 50 < 50 - o_orderkey div 50 % 7").selectExpr(
        "'F' || cast(o_orderkey as string) uuid",
        "case when o_orderkey % 83 = 0 then 'lost' else 'O' || cast(o_orderkey as string) end point_uuid",
        "o_orderdate capture_time",
        "cast(40 + o_orderkey % 60 as int) current_speed",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan boxes as text minLon,minLat,maxLon,maxLat, of four sizes.

    One per supplier, ten to each degree going east; a region of two degrees for
    every tenth, a street of about ten metres for every third, one country around all,
    and texts that are no box for every fiftieth.
    """
    suppliers = table(spark, sf_dir, "supplier")
    usual = suppliers.selectExpr(
        "'Box ' || cast(s_suppkey as string) name",
        """concat_ws(',', cast(cast(110 + s_suppkey * 0.1 as decimal(9,2)) as string),
             cast(cast(1 + s_suppkey % 7 * 0.05 as decimal(5,2)) as string),
             cast(cast(110.15 + s_suppkey * 0.1 as decimal(9,2)) as string),
             cast(cast(1.08 + s_suppkey % 7 * 0.05 as decimal(5,2)) as string)) bbox""",
    )
    regions = suppliers.where("s_suppkey % 10 = 0").selectExpr(
        "'Region ' || cast(s_suppkey as string) name",
        "concat_ws(',', cast(110 + s_suppkey div 10 as string), '1', cast(112 + s_suppkey div 10 as string), '1.25') bbox",
    )
    streets = suppliers.where("s_suppkey % 3 = 0").selectExpr(
        "'Street ' || cast(s_suppkey as string) name",
        "concat_ws(',', cast(110 + s_suppkey as string), '1', cast(110 + s_suppkey as string) || '.0001', '1.5') bbox",
    )
    rest = suppliers.where("s_suppkey % 50 = 0 or s_suppkey = 1").selectExpr(
        "case when s_suppkey = 1 then 'Country' else 'Unread ' || cast(s_suppkey as string) end name",
        "case when s_suppkey = 1 then '100,0,900,7' when s_suppkey % 100 = 0 then 'everywhere' else '111,2,110,1' end bbox",
    )
    return usual.unionByName(regions).unionByName(streets).unionByName(rest)


def block_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as boxes on the map: a grid of half degrees going east, every fifth missing, all inside one large one."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "case when s_suppkey = 1 then 'rest' else 'B' || cast(s_suppkey as string) end name",
        """case when s_suppkey = 1 then '109,0,115,1.03125' when s_suppkey % 5 = 0 then ''
             else concat_ws(',', cast(110 + (s_suppkey - 2) / 64.0D as string), '1', cast(110 + (s_suppkey - 1) / 64.0D as string), '1.5') end bbox""",
    )


def vehicle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "1.0D + (event_id % 512) / 1024.0D latitude",
        "110.0D + event_id / 1000.0D longitude",
    )


def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-supplied calendar: which dates count as affected (rain, holiday)."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr("to_date(ts) date")
        .distinct()
        .selectExpr("date", "case when dayofmonth(date) % 4 = 0 then 'affected' else 'normal' end label")
    )


def point_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road length each observed point stands for; every eleventh point has none."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr("user_id % 42 + 1 n")
        .where("n % 11 <> 0")
        .distinct()
        .selectExpr("'P' || lpad(cast(n as string), 2, '0') point_id", "1.0D + (n % 8) / 4.0D weight")
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data dictionary, as a user keeps one: an entry per numeric measure, with the largest value seen so far."""
    return table(spark, sf_dir, "events").agg(F.max("value").alias("top")).selectExpr(
        """stack(3,
             'current_speed', 'km/h', 'speed of the probe', cast(null as string),
             'ci_percent', '%', 'extra travel time over free flow', 'largest input value ' || cast(top as string),
             'not_a_column', '', 'belongs to no table', cast(null as string)) as (variable, unit, definition, note)""")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, closed by one row far in the future.

    The closing row moves the watermark past all real data, so that append
    mode gives out every window. Its own window never closes. The events are
    streamed from where they are; only the one row is written.
    """
    schema = table(spark, sf_dir, "events").schema
    folder = work_folder(spark, "closing-row")
    spark.range(1).selectExpr(
        "1L event_id", "timestamp_ntz'2100-01-01 00:00:00' ts", "0L user_id", "'view' event_type", "0.0D value", "'{}' props"
    ).coalesce(1).write.mode("overwrite").parquet(folder)
    # A glob, because a stream source given as a plain path must be a folder.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return events.unionByName(spark.readStream.schema(schema).parquet(folder))


#: Shares that the landed files are read in, a micro-batch each.
SHARES = 3


def files_per_share(spark: SparkSession) -> int:
    """Landed files of a share, so that there is a file for every core that writes them."""
    return math.ceil(spark.sparkContext.defaultParallelism / SHARES)


def _landed(documents: DataFrame, name: str) -> str:
    spark = documents.sparkSession
    folder = f"{work_folder(spark, 'landing')}/{name}"
    documents.repartition(SHARES * files_per_share(spark)).write.option("timestampNTZFormat", ENVELOPE_TIME).json(folder)
    return folder


def landed_point_payloads(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the point documents as a collector would drop them: JSON lines in ``SHARES * files_per_share`` files."""
    return _landed(point_payload(spark, sf_dir), "point")


def landed_segment_payloads(spark: SparkSession, sf_dir: str) -> str:
    return _landed(segment_payload(spark, sf_dir), "segment")


def events_in_runs(spark: SparkSession, sf_dir: str, order: tuple[int, ...], start: Callable[[DataFrame], StreamingQuery], closing: bool = False) -> None:
    """Lands the events in three parts, ten days each, in the given order, and runs the stream after each part.

    Every run starts a new query on the same checkpoint and sees one part.
    ``closing`` lands a last row far in the future, which moves the watermark past all others.
    """
    events = table(spark, sf_dir, "events")
    folder = work_folder(spark, "landed-events")
    days = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    parts = [events.where(days == n) for n in order]
    if closing:
        parts.append(spark.range(1).selectExpr("-1L event_id", "timestamp_ntz'2100-01-01 00:00:00' ts", "0L user_id", "'closing' event_type", "0.0D value", "'{}' props"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(events.schema).parquet(folder)).awaitTermination()
