"""Vendor JSON documents to flow rows, shape rows and rejects.

Numbers are read as text and converted afterwards, because the collectors
accept 12, 12.7 and "12" alike. A missing number is stored as 0, never null.
Row ids are digests of the document id and position: a task that runs again
gives the same ids, which random ids would not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probegrid.operators.spatial import segment_to_block

POINT_DOCUMENT = """
flowSegmentData STRUCT<currentSpeed STRING, freeFlowSpeed STRING, currentTravelTime STRING,
  freeFlowTravelTime STRING, confidence STRING, roadClosure STRING,
  coordinates STRUCT<coordinate ARRAY<STRUCT<latitude STRING, longitude STRING>>>>,
_corrupt_record STRING
"""

SEGMENT_DOCUMENT = """
results ARRAY<STRUCT<
  location STRUCT<description STRING, length STRING, shape STRUCT<links ARRAY<STRUCT<
    length STRING, functionalClass STRING, points ARRAY<STRUCT<lat STRING, lng STRING>>>>>>,
  currentFlow STRUCT<speed STRING, jamFactor STRING>>>,
_corrupt_record STRING
"""


@dataclass(frozen=True)
class Ingested:
    flows: DataFrame
    shapes: DataFrame
    rejects: DataFrame


def _whole(c: Column) -> Column:
    return F.trim(c).try_cast("double").try_cast("int")


def _double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _unread(c: Column, read=_whole) -> Column:
    """True for a number that is there and cannot be stored."""
    # most numbers are fine: they are read once, and only the others are looked at again
    return F.nanvl(read(c).cast("double"), F.lit(None).cast("double")).isNull() & F.coalesce(F.trim(c) != "", F.lit(False))


def _parsed(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Add the parsed document, through a one-row ``explode``: filters on it
    stay above, where pushed below they would parse the text again."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return df.select("*", F.explode(F.array(F.from_json(F.col(payload), schema, options))).alias("doc"))


def _split(df: DataFrame, reason: Column, settle: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reject_reason", reason)
    if settle is not None:
        marked = settle(marked)
    return marked.where("reject_reason is null"), marked.where("reject_reason is not null")


def parse_point_payloads(df: DataFrame, payload: str = "js", settle: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """``df`` holds point_uuid, capture_time and the document text.

    A document without a coordinates object, or with a number that cannot be
    stored, is rejected whole; an empty coordinate list keeps its flow row and
    gives no shape rows. ``settle`` may hold on to the parsed documents, for
    writers of all three tables.
    """
    seg = F.col("doc.flowSegmentData")
    reason = (
        F.when(F.col(payload).isNull() | (F.trim(payload) == ""), "empty")
        .when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), "unparseable")
        .when(seg.isNull(), "no_flow_segment")
        .when(seg["coordinates"].isNull(), "no_coordinates")
        .when(
            _unread(seg["currentSpeed"]) | _unread(seg["freeFlowSpeed"]) | _unread(seg["currentTravelTime"]) | _unread(seg["freeFlowTravelTime"])
            | _unread(seg["confidence"], _double)
            | F.exists(seg["coordinates"]["coordinate"], lambda c: _unread(c["latitude"], _double) | _unread(c["longitude"], _double)),
            "bad_number",
        )
    )
    good, bad = _split(_parsed(df, payload, POINT_DOCUMENT), reason, settle)
    good = good.withColumn("uuid", F.md5(F.concat_ws("#", F.col("point_uuid"), F.col("capture_time").cast("string"))))
    zero = F.lit(0)
    flows = good.select(
        "uuid",
        "point_uuid",
        F.col("capture_time").cast("timestamp_ntz").alias("capture_time"),
        F.coalesce(_whole(seg["currentSpeed"]), zero).alias("current_speed"),
        F.coalesce(_whole(seg["freeFlowSpeed"]), zero).alias("free_flow_speed"),
        F.coalesce(_whole(seg["currentTravelTime"]), zero).alias("current_travel_time"),
        F.coalesce(_whole(seg["freeFlowTravelTime"]), zero).alias("free_flow_travel_time"),
        F.coalesce(_double(seg["confidence"]), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.lower(F.trim(seg["roadClosure"])).isin("true", "1"), F.lit(False)).alias("road_closure"),
    )
    shapes = good.select("uuid", F.posexplode(seg["coordinates"]["coordinate"]).alias("pos", "c")).select(
        F.col("uuid").alias("flow_uuid"),
        F.coalesce(_double(F.col("c.latitude")), F.lit(0.0)).alias("latitude"),
        F.coalesce(_double(F.col("c.longitude")), F.lit(0.0)).alias("longitude"),
        (F.col("pos") + 1).alias("sequence_order"),
    )
    rejects = bad.select("point_uuid", "capture_time", "reject_reason", F.col(payload).alias("payload"))
    return Ingested(flows, shapes, rejects)


def _bad_result(r: Column) -> Column:
    """True if a number of a segment result, its links or their points cannot be stored."""
    def bad_link(k: Column) -> Column:
        return _unread(k["length"]) | _unread(k["functionalClass"]) | F.exists(
            k["points"], lambda p: _unread(p["lat"], _double) | _unread(p["lng"], _double))

    flow = r["currentFlow"]
    return (
        _unread(r["location"]["length"]) | _unread(flow["speed"], _double) | _unread(flow["jamFactor"], _double)
        | F.exists(r["location"]["shape"]["links"], bad_link)
    )


def parse_segment_payloads(df: DataFrame, payload: str = "js", settle: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """``df`` holds batch_id, place_id, capture_time and the document text.

    One unusable result rejects its whole document, as its rows are stored
    in one transaction. Shape points are numbered across all links of a
    result inside the row: arrays are flattened, nothing is shuffled.
    """
    results = F.col("doc.results")
    unusable = F.exists(
        results,
        lambda r: r["location"].isNull()
        | r["location"]["shape"]["links"].isNull()
        | F.exists(r["location"]["shape"]["links"], lambda k: k["points"].isNull()),
    )
    reason = (
        F.when(F.col(payload).isNull() | (F.trim(payload) == ""), "empty")
        .when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), "unparseable")
        .when(results.isNull() | (F.size(results) == 0), "no_results")
        .when(unusable, "incomplete_result")
        .when(F.exists(results, _bad_result), "bad_number")
    )
    good, bad = _split(_parsed(df, payload, SEGMENT_DOCUMENT), reason, settle)
    rows = good.select("batch_id", "place_id", "capture_time", F.posexplode(results).alias("pos", "r")).withColumn(
        "doc_key", F.concat_ws("#", "batch_id", "place_id", F.col("pos").cast("string"))
    )
    flow_key = F.md5(F.concat_ws("#", F.lit("shape"), "doc_key")).alias("bbox_uuid")
    measured = lambda c: F.when(F.col("r.currentFlow").isNull(), F.lit(0.0)).otherwise(_double(c))
    flows = rows.select(
        F.md5("doc_key").alias("uuid"),
        flow_key,
        "batch_id",
        "place_id",
        F.col("capture_time").cast("timestamp_ntz").alias("capture_time"),
        F.col("r.location.description").alias("road_name"),
        F.size("r.location.shape.links").alias("number_roads"),
        measured(F.col("r.currentFlow.speed")).alias("speed_kmh"),
        measured(F.col("r.currentFlow.jamFactor")).alias("jam_factor"),
    )
    points = F.flatten(F.transform(
        F.col("r.location.shape.links"),
        lambda k: F.transform(k["points"], lambda p: F.struct(
            p["lat"].alias("lat"), p["lng"].alias("lng"),
            k["length"].alias("zl_length"), k["functionalClass"].alias("functional_class"),
        )),
    ))
    shapes = rows.select(
        flow_key,
        F.col("r.location.description").alias("all_description_str"),
        _whole(F.col("r.location.length")).alias("all_length"),
        F.posexplode(points).alias("seq", "p"),
    ).select(
        F.col("bbox_uuid").alias("flow_uuid"),
        _double(F.col("p.lat")).alias("latitude"),
        _double(F.col("p.lng")).alias("longitude"),
        _whole(F.col("p.functional_class")).alias("functional_class"),
        "all_description_str",
        "all_length",
        _whole(F.col("p.zl_length")).alias("zl_length"),
        (F.col("seq") + 1).alias("sequence_order"),
    )
    rejects = bad.select("batch_id", "place_id", "capture_time", "reject_reason", F.col(payload).alias("payload"))
    return Ingested(flows, shapes, rejects)


def point_feed(flows: DataFrame) -> DataFrame:
    """Stored point flows as input of the point cleaning (capture_time is the time).

    The id comes from the lineage join; see ``operators.lineage``.
    """
    return flows.withColumnRenamed("capture_time", "timestamp")


def segment_feed(flows: DataFrame, blocks: DataFrame, speed_factor: float = 1.0) -> DataFrame:
    """Stored segment flows as input of the segment cleaning.

    A place listed twice in ``blocks`` fails the job. ``speed_factor`` converts the stored speed to km/h where the source
    delivered another unit.
    """
    return segment_to_block(flows, blocks).select(
        "block_id",
        F.col("capture_time").alias("timestamp"),
        (F.col("speed_kmh") * F.lit(speed_factor)).alias("speed"),
        "jam_factor",
        F.col("road_name").alias("segment_id"),
        "place_id",
    )
