"""Intraday profiles of the cleaned point table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probegrid.functions.scalars import day_type, time_of_day


def intraday_profile(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(time_of_day(F.col("interval_15min")).alias("time_of_day")).agg(
        F.avg("current_speed").alias("mean_current_speed"),
        F.avg("ci_percent").alias("mean_ci_percent"),
        F.avg("tti").alias("mean_tti"),
        F.avg("srr").alias("mean_srr"),
        F.count("*").alias("record_count"),
    )


def day_type_profile(cleaned: DataFrame) -> DataFrame:
    slot = F.col("interval_15min")
    return cleaned.groupBy(time_of_day(slot).alias("time_of_day"), day_type(slot).alias("day_type")).agg(
        F.avg("current_speed").alias("mean_current_speed"),
        F.avg("ci_percent").alias("mean_ci_percent"),
        F.avg("tti").alias("mean_tti"),
        F.count("*").alias("record_count"),
    )


def with_zscores(profile: DataFrame) -> DataFrame:
    """Standardise CI and TTI over the profile.

    A profile has 96 rows however long the feed is, so the window over the
    whole table stays small.
    """
    whole = Window.partitionBy()

    def z(c: str):
        return (F.col(c) - F.avg(c).over(whole)) / F.nullif(F.stddev_samp(c).over(whole), F.lit(0.0))

    return profile.select("*", z("mean_ci_percent").alias("z_ci_percent"), z("mean_tti").alias("z_tti"))


def moving_average(cleaned: DataFrame, measure: str = "ci_percent", slots: int = 4) -> DataFrame:
    """Mean over the last ``slots`` records and over the same span of time.

    Needs the cleaned table: with one record per point and slot, a point's
    window partition grows with the calendar only, 96 rows a day.
    """
    per_point = Window.partitionBy("point_id").orderBy("interval_15min").rowsBetween(-(slots - 1), 0)
    return cleaned.select(
        "point_id",
        "interval_15min",
        measure,
        F.avg(measure).over(per_point).alias("mean_last_records"),
        F.expr(
            f"avg({measure}) over (partition by point_id order by interval_15min "
            f"range between interval '{(slots - 1) * 15}' minute preceding and current row)"
        ).alias("mean_time_span"),
    )
