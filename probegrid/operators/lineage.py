"""From stored rows back to points and road geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def traced_flows(flows: DataFrame, assignments: DataFrame, points: DataFrame) -> DataFrame:
    """Every flow row with its assignment's run and point, as far as they are known, and ``link``.

    A flow names its assignment; the assignment carries the point's exact
    decimal position. ``link`` is ``linked``, ``no_assignment`` or ``no_point``. An
    assignment or a position listed twice fails the job.
    """
    link = _once(assignments, ["uuid"], ["pd_uuid", "latitude", "longitude"], "assignment").withColumnRenamed("uuid", "_assignment")
    site = _once(points, ["latitude", "longitude"], ["original_id"], "point position").select(
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("original_id").alias("point_id"))
    traced = flows.join(link, F.col("point_uuid") == F.col("_assignment"), "left")
    traced = traced.join(site, (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon")), "left")
    state = F.when(F.col("_assignment").isNull(), "no_assignment").when(F.col("_lat").isNull(), "no_point").otherwise("linked")
    return traced.withColumn("link", state).drop("_assignment", "_lat", "_lon")


def _once(df: DataFrame, key: list[str], values: list[str], what: str) -> DataFrame:
    """One row per key; the job that meets a key with two rows fails."""
    found = df.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(v).alias(v) for v in values])
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in key])
    head = F.when(F.col("_n") == 1, F.col(values[0])).otherwise(F.raise_error(F.concat(F.lit(f"{what} listed twice: "), name)))
    return found.select(*key, head.alias(values[0]), *values[1:])


def flow_to_point(flows: DataFrame, assignments: DataFrame, points: DataFrame) -> DataFrame:
    """The linked flows with their monitoring point."""
    return traced_flows(flows, assignments, points).where("link = 'linked'").drop("link")


def unlinked_flows(flows: DataFrame, assignments: DataFrame, points: DataFrame) -> DataFrame:
    """The flows that lead to no point, with the reason in ``link``."""
    return traced_flows(flows, assignments, points).where("link <> 'linked'")


def lineage_report(flows: DataFrame, assignments: DataFrame, points: DataFrame) -> DataFrame:
    """Flows, days and first and last time per ``link``: how much of the feed reaches the map."""
    return traced_flows(flows, assignments, points).groupBy("link").agg(
        F.count("*").alias("flows"), F.count_distinct(F.to_date("capture_time")).alias("days"),
        F.min("capture_time").alias("first_capture"), F.max("capture_time").alias("last_capture"))


def segment_geometry(flows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Flow rows with their shape points in order.

    Shapes refer to the flow's ``bbox_uuid``. A group is the geometry of one
    road in one document, so the collected path is bounded by that document. Both
    sides grow alike and neither is ever broadcast: where they come out of documents,
    Spark knows their sizes only from the texts, far too small.
    """
    path = F.array_sort(F.collect_list(F.struct("sequence_order", "latitude", "longitude")))
    paths = shapes.groupBy(F.col("flow_uuid").alias("bbox_uuid")).agg(path.alias("path"))
    return flows.join(paths.hint("merge"), "bbox_uuid", "left")
