"""Congestion indicators of one point record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probegrid.functions.scalars import holds, ratio


def speed_reduction(current: Column, free: Column) -> Column:
    return ratio(free - current, free)


def travel_time_index(current: Column, free: Column) -> Column:
    return ratio(current, free)


def congestion_percent(current: Column, free: Column) -> Column:
    """Below zero where traffic beats free flow; never clipped."""
    return ratio(current - free, free) * 100


def with_indicators(df: DataFrame) -> DataFrame:
    """Add SRR, TTI, ETT, CI, the second CI formula and its checks."""
    v, v0 = F.col("current_speed"), F.col("free_flow_speed")
    t, t0 = F.col("current_travel_time"), F.col("free_flow_travel_time")
    base = df.select(
        "*",
        speed_reduction(v, v0).alias("srr"),
        travel_time_index(t, t0).alias("tti"),
        (t - t0).alias("ett_seconds"),
        congestion_percent(t, t0).alias("ci_percent"),
        ((travel_time_index(t, t0) - 1) * 100).alias("ci_percent_from_tti"),
    )
    return base.select(
        "*",
        F.abs(F.col("ci_percent") - F.col("ci_percent_from_tti")).alias("ci_formula_abs_error"),
        holds(F.col("ci_percent") < 0).alias("ci_negative_flag"),
    )
