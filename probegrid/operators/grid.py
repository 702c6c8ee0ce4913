"""Both feeds on the common block by 30-minute grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.functions.order_stats import percentiles
from probegrid.functions.scalars import floor_minutes, id_text, ratio

BLOCK_SLOT = ["block_id", "interval_30min"]

POINT_MEANS = {
    "current_speed": "tomtom_current_speed",
    "free_flow_speed": "tomtom_free_flow_speed",
    "current_travel_time": "tomtom_current_travel_time",
    "free_flow_travel_time": "tomtom_free_flow_travel_time",
    "ci_percent": "tomtom_ci_percent",
    "tti": "tomtom_tti",
    "srr": "tomtom_srr",
    "ett_seconds": "tomtom_ett_seconds",
}

BLOCK_MEANS = {
    "tomtom_current_speed": "tomtom_mean_current_speed",
    "tomtom_free_flow_speed": "tomtom_mean_free_flow_speed",
    "tomtom_current_travel_time": "tomtom_mean_current_travel_time",
    "tomtom_free_flow_travel_time": "tomtom_mean_free_flow_travel_time",
    "tomtom_ci_percent": "tomtom_mean_ci_percent",
    "tomtom_tti": "tomtom_mean_tti",
    "tomtom_srr": "tomtom_mean_srr",
    "tomtom_ett_seconds": "tomtom_mean_ett_seconds",
}


def point_blocks(config: DataFrame) -> DataFrame:
    """point_id to block_id; fails in the job if a point has two rows."""
    types = {f.name: f.dataType for f in config.schema}
    point = id_text(F.col("point_id"), types["point_id"])
    block = id_text(F.col("block_id"), types["block_id"])
    once = config.groupBy(point.alias("point_id")).agg(F.count("*").alias("n"), F.max(block).alias("block"))
    return once.select(
        "point_id",
        F.when(F.col("n") == 1, F.col("block"))
        .otherwise(F.raise_error(F.concat(F.lit("point configured twice: "), F.col("point_id"))))
        .alias("block_id"),
    )


def point_layout(config: DataFrame) -> DataFrame:
    """point_id as the records have it, and its place along the corridor."""
    point = id_text(F.col("point_id"), {f.name: f.dataType for f in config.schema}["point_id"])
    return config.select(point.alias("point_id"), "corridor_order")


def unassigned_points(cleaned: DataFrame, config: DataFrame) -> DataFrame:
    """All ids without a block, in id order."""
    known = point_blocks(config).where(F.col("block_id").isNotNull())
    return cleaned.select("point_id").distinct().join(known, "point_id", "left_anti").orderBy("point_id")


def assign_blocks(cleaned: DataFrame, config: DataFrame) -> DataFrame:
    """Add block_id; a point without a block fails the job that meets it.

    No broadcast hint: Spark broadcasts the layout while it is below
    ``autoBroadcastJoinThreshold`` and shuffles it beyond.
    """
    joined = cleaned.join(point_blocks(config), "point_id", "left")
    missing = F.raise_error(F.concat(F.lit("no block for point "), F.col("point_id")))
    return joined.withColumn("block_id", F.coalesce(F.col("block_id"), missing))


def point_30min(cleaned: DataFrame, config: DataFrame) -> DataFrame:
    """Means of each point over 30 minutes."""
    slotted = assign_blocks(cleaned, config).withColumn(
        "interval_30min", floor_minutes(F.col("interval_15min"), 30)
    )
    return slotted.groupBy("block_id", "point_id", "interval_30min").agg(
        *[F.avg(c).alias(new) for c, new in POINT_MEANS.items()],
        F.count("*").alias("tomtom_15min_count"),
    )


def block_30min(cleaned: DataFrame, config: DataFrame) -> DataFrame:
    """Unweighted mean of point means per block and 30 minutes.

    A group has one row per configured point at most, so the built-in exact
    median holds no more than one block's points.
    """
    means = [F.avg(c).alias(new) for c, new in BLOCK_MEANS.items()]
    means.insert(5, F.median("tomtom_ci_percent").alias("tomtom_median_ci_percent"))
    grid = point_30min(cleaned, config).groupBy(*BLOCK_SLOT).agg(
        *means,
        F.count("*").alias("tomtom_point_count"),
        F.sum("tomtom_15min_count").alias("tomtom_record_count_15min"),
    )
    return grid.withColumn("date", F.to_date("interval_30min"))


def point_weights(weights: DataFrame) -> DataFrame:
    """point_id to weight; fails in the job if a point has two rows or its weight is not above zero."""
    point = id_text(F.col("point_id"), {f.name: f.dataType for f in weights.schema}["point_id"])
    once = weights.groupBy(point.alias("point_id")).agg(F.count("*").alias("n"), F.max("weight").alias("w"))
    wrong = F.raise_error(F.concat(F.lit("one weight above zero is needed for point "), F.col("point_id")))
    return once.select("point_id", F.when((F.col("n") == 1) & (F.col("w") > 0), F.col("w").cast("double")).otherwise(wrong).alias("weight"))


def block_30min_weighted(cleaned: DataFrame, config: DataFrame, weights: DataFrame) -> DataFrame:
    """Block means weighted by road length; ``weights`` has point_id and weight.

    Points without a weight cannot enter a weighted mean. They are counted in each
    block-slot (``unweighted_points``); a block-slot of such points only has null means.
    """
    rows = point_30min(cleaned, config).join(point_weights(weights), "point_id", "left")
    w = F.col("weight")
    return rows.groupBy(*BLOCK_SLOT).agg(
        ratio(F.sum(F.col("tomtom_ci_percent") * w), F.sum(w)).alias("weighted_ci_percent"),
        ratio(F.sum(F.col("tomtom_current_speed") * w), F.sum(w)).alias("weighted_current_speed"),
        F.sum(w).alias("total_weight"),
        F.count_if(w.isNull()).alias("unweighted_points"),
    )


def unweighted_points(cleaned: DataFrame, weights: DataFrame) -> DataFrame:
    """Points with records and no weight, with their number of records."""
    seen = cleaned.groupBy("point_id").agg(F.count("*").alias("records"))
    return seen.join(point_weights(weights), "point_id", "left_anti")


def segment_block_time(valid: DataFrame) -> DataFrame:
    """Segment records per block and 30 minutes, without dedup.

    Means are combined before the shuffle, segments are counted in two steps and
    medians come from counted values, so one block-slot may hold most records.
    ``valid`` is read twice.
    """
    core = valid.groupBy(*BLOCK_SLOT).agg(
        F.avg("speed").alias("here_mean_speed"),
        F.avg("jam_factor").alias("here_mean_jam_factor"),
        F.count("*").alias("here_record_count"),
        F.avg("confidence").alias("here_mean_confidence"),
        F.count_distinct("segment_id").alias("here_segment_count"),
    )
    medians = percentiles(valid, BLOCK_SLOT, ["speed", "jam_factor"], {"median": 0.5})
    return core.join(medians, BLOCK_SLOT).select(
        *BLOCK_SLOT,
        "here_mean_speed",
        F.col("speed_median").alias("here_median_speed"),
        "here_mean_jam_factor",
        F.col("jam_factor_median").alias("here_median_jam_factor"),
        "here_segment_count",
        "here_record_count",
        "here_mean_confidence",
        F.to_date("interval_30min").alias("date"),
    )


def match_block_time(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Block-slots both feeds cover, with both main measures present."""
    left = points.where(F.col("tomtom_mean_ci_percent").isNotNull())
    left = left.withColumn("block_id", F.col("block_id").cast("string")).withColumnRenamed("date", "date_tomtom")
    right = segments.where(F.col("here_mean_jam_factor").isNotNull())
    right = right.withColumn("block_id", F.col("block_id").cast("string")).withColumnRenamed("date", "date_here")
    return left.join(right, BLOCK_SLOT).withColumn("date", F.to_date("interval_30min"))
