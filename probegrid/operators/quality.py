"""Validity flags, cleaning and daily cleaning logs of both feeds."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.functions.indicators import with_indicators
from probegrid.functions.scalars import all_of, holds, ratio
from probegrid.operators.dedup import duplicates_of, keep_first
from probegrid.operators.normalize import standardize_points, standardize_segments
from probegrid.schema import EXPECTED_PER_DAY, POINT_CORE, SEGMENT_CORE


class PointTables:
    """Tables of the cleaned point feed; each is planned when first asked for."""

    def __init__(self, flagged: DataFrame, expected: int = EXPECTED_PER_DAY):
        self.flagged = flagged
        self.expected = expected

    @cached_property
    def valid(self) -> DataFrame:
        return self.flagged.where("is_valid_base")

    @cached_property
    def kept(self) -> DataFrame:
        return keep_first(self.valid)

    @cached_property
    def cleaned(self) -> DataFrame:
        return with_indicators(self.kept.withColumn("is_duplicate_removed", F.lit(False)))

    @cached_property
    def daily_availability(self) -> DataFrame:
        return daily_availability(self.cleaned, self.expected)

    @cached_property
    def cleaning_log(self) -> DataFrame:
        return point_cleaning_log(self.flagged)

    @cached_property
    def duplicate_log(self) -> DataFrame:
        return duplicates_of(self.valid, self.kept).withColumn("is_duplicate_removed", F.lit(True))


class SegmentTables:
    """Tables of the cleaned segment feed."""

    def __init__(self, flagged: DataFrame):
        self.flagged = flagged

    @cached_property
    def valid(self) -> DataFrame:
        return self.flagged.where("is_valid")

    @cached_property
    def cleaning_log(self) -> DataFrame:
        return segment_cleaning_log(self.flagged)


def _positive(*columns: str):
    return holds(all_of([F.col(c) > 0 for c in columns]))


def flag_points(df: DataFrame, require_confidence: bool = False) -> DataFrame:
    """Add the six checks and ``is_valid_base``; every flag is true or false.

    A slot exists exactly where the time could be read, so the time itself is
    tested: the filter is shorter and reaches the scan of typed inputs.
    """
    flagged = df.select(
        "*",
        F.col("timestamp").isNotNull().alias("valid_time"),
        all_of([F.col(c).isNotNull() for c in POINT_CORE]).alias("valid_core_fields"),
        _positive("current_speed", "free_flow_speed").alias("valid_speed"),
        _positive("current_travel_time", "free_flow_travel_time").alias("valid_travel_time"),
        (~F.col("road_closure_bool")).alias("valid_closure"),
        F.col("confidence").isNotNull().alias("confidence_exists"),
    )
    checks = ["valid_time", "valid_core_fields", "valid_speed", "valid_travel_time", "valid_closure"]
    if require_confidence:
        checks.append("confidence_exists")
    return flagged.withColumn("is_valid_base", all_of([F.col(c) for c in checks]))


def flag_segments(df: DataFrame) -> DataFrame:
    """Add the segment checks and ``is_valid``; jam factors have no upper bound."""
    flagged = df.select(
        "*",
        F.col("timestamp").isNotNull().alias("valid_time"),
        all_of([F.col(c).isNotNull() for c in SEGMENT_CORE]).alias("valid_core_fields"),
        _positive("speed").alias("valid_speed"),
        holds(F.col("jam_factor") >= 0).alias("valid_jam_factor"),
        F.col("confidence").isNotNull().alias("confidence_exists"),
    )
    checks = ["valid_time", "valid_core_fields", "valid_speed", "valid_jam_factor"]
    return flagged.withColumn("is_valid", all_of([F.col(c) for c in checks]))


def _failed(flag: str):
    return F.count_if(~F.col(flag))


def point_cleaning_log(flagged: DataFrame) -> DataFrame:
    """Counts per date, records without a date as a group of their own.

    Kept records are the distinct (point, slot) pairs among valid ones, so
    the log needs neither the sorted dedup nor a join, and both aggregation
    steps combine before their shuffle.
    """
    valid = F.col("is_valid_base")
    kept = F.count_distinct(F.when(valid, F.col("point_id")), F.when(valid, F.col("interval_15min")))
    log = flagged.groupBy("date").agg(
        F.count("*").alias("raw_records"),
        _failed("valid_time").alias("invalid_time_records"),
        _failed("valid_core_fields").alias("missing_core_field_records"),
        _failed("valid_speed").alias("non_positive_speed_records"),
        _failed("valid_travel_time").alias("non_positive_travel_time_records"),
        _failed("valid_closure").alias("closure_related_records"),
        _failed("confidence_exists").alias("confidence_missing_records"),
        (F.count_if(valid) - kept).alias("duplicate_records"),
        kept.alias("valid_records"),
    )
    return log.withColumn("cleaning_pass_rate", F.col("valid_records") / F.col("raw_records"))


def segment_cleaning_log(flagged: DataFrame) -> DataFrame:
    """Counts per date of the segment feed, records without a date included."""
    log = flagged.groupBy("date").agg(
        F.count("*").alias("raw_records"),
        _failed("valid_time").alias("invalid_time_records"),
        _failed("valid_core_fields").alias("missing_core_field_records"),
        _failed("valid_speed").alias("non_positive_speed_records"),
        _failed("valid_jam_factor").alias("negative_jam_factor_records"),
        F.count_if(F.col("is_valid")).alias("valid_records"),
    )
    return log.withColumn("cleaning_pass_rate", F.col("valid_records") / F.col("raw_records"))


def availability_of_counts(counted: DataFrame, expected: int = EXPECTED_PER_DAY) -> DataFrame:
    """Rates and flag from ``date`` and ``observed_records``."""
    rate = F.col("observed_records") / F.lit(expected)
    return counted.select(
        "date",
        "observed_records",
        F.lit(expected).cast("bigint").alias("expected_records"),
        rate.alias("availability_rate"),
        (F.lit(expected) - F.col("observed_records")).alias("missing_records"),
        (1 - rate).alias("missing_rate"),
        F.when(F.col("observed_records") <= expected, "OK").otherwise("CHECK_OBSERVED_GT_EXPECTED").alias("availability_check_flag"),
    )


def daily_availability(cleaned: DataFrame, expected: int = EXPECTED_PER_DAY) -> DataFrame:
    """Observed against expected records per date; gaps are never filled."""
    counted = cleaned.where(F.col("date").isNotNull()).groupBy("date").agg(F.count("*").alias("observed_records"))
    return availability_of_counts(counted, expected)


def clean_points(
    raw: DataFrame, require_confidence: bool = False, expected: int = EXPECTED_PER_DAY, date_from=None, date_to=None
) -> PointTables:
    """Parse, flag, filter, keep the first per slot and add indicators; all lazy."""
    return PointTables(flag_points(standardize_points(raw, date_from, date_to), require_confidence), expected)


def clean_segments(raw: DataFrame, date_from=None, date_to=None) -> SegmentTables:
    return SegmentTables(flag_segments(standardize_segments(raw, date_from, date_to)))


def formula_check(cleaned: DataFrame) -> DataFrame:
    """Largest gap between the two congestion formulas, with counts."""
    return cleaned.agg(
        F.count("*").alias("cleaned_records"),
        F.max("ci_formula_abs_error").alias("max_ci_formula_abs_error"),
        F.count_if(F.col("ci_negative_flag")).alias("negative_ci_records"),
        ratio(F.count_if(F.col("ci_negative_flag")), F.count("*").cast("double")).alias("negative_ci_share"),
    )
