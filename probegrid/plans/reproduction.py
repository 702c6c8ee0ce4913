"""The whole workflow: two raw feeds and a layout in, fifteen tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probegrid.operators import checks, consistency, grid, profiles, quality
from probegrid.schema import EXPECTED_PER_DAY, PEAK_QUANTILE
from probegrid.session import stored
from probegrid.sources.tables import read_point_config, read_table, replace_partitions, with_dictionary, write_csv, write_table

BY_DATE = {"tomtom_cleaned_point_time", "tomtom_duplicate_log", "tomtom_block_30min", "here_cleaned_block_time", "matched_tomtom_here_30min"}
#: One row per date: small enough to be written in date order.
IN_DATE_ORDER = {"tomtom_daily_availability", "tomtom_cleaning_log_by_date", "here_cleaning_log_by_date", "sensitivity_daily"}


def _measures(name: str) -> dict[str, Column]:
    """What is measured while a table is written, beside its rows."""
    return {
        "tomtom_cleaned_point_time": lambda: {"formula_error": F.max("ci_formula_abs_error"), "negative": F.count_if(F.col("ci_negative_flag"))},
        "tomtom_daily_availability": lambda: {"most_observed": F.max("observed_records")},
        "tomtom_cleaning_log_by_date": lambda: {"raw": F.sum("raw_records")},
        "here_cleaning_log_by_date": lambda: {"raw": F.sum("raw_records"), "valid": F.sum("valid_records")},
    }.get(name, dict)()


class _Sink:
    """Writes each table as it is made, and hands back the written one."""

    def __init__(self, spark: SparkSession, out: str | None, csv: bool, dictionary: DataFrame | None):
        self.spark, self.out, self.csv, self.dictionary = spark, out and out.rstrip("/"), csv, dictionary
        self.tables: dict[str, DataFrame] = {}
        self.measured: dict[str, dict] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        if name in IN_DATE_ORDER:
            df = df.orderBy(F.asc_nulls_last("date"))
        if self.dictionary is not None:
            df = with_dictionary(df, self.dictionary)
        if self.out:
            path = f"{self.out}/{name}"
            self.measured[name] = write_table(df, path, ["date"] if name in BY_DATE else None, measures=_measures(name))
            df = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
            if self.csv:
                write_csv(df, f"{self.out}/csv/{name}")
        self.tables[name] = df
        return df


@dataclass(frozen=True)
class Run:
    """Tables of a run, and what was measured while each was written."""

    tables: dict[str, DataFrame]
    measured: dict[str, dict]


def run_all(spark: SparkSession, point_raw: DataFrame, segment_raw: DataFrame, config: DataFrame, out: str | None = None, **options) -> dict[str, DataFrame]:
    """The tables of ``run_measured``."""
    return run_measured(spark, point_raw, segment_raw, config, out, **options).tables


def run_measured(
    spark: SparkSession,
    point_raw: DataFrame,
    segment_raw: DataFrame,
    config: DataFrame,
    out: str | None = None,
    require_confidence: bool = False,
    peak_q: float = PEAK_QUANTILE,
    expected: int = EXPECTED_PER_DAY,
    csv: bool = False,
    dictionary: DataFrame | None = None,
) -> Run:
    """Clean, aggregate, match, summarise and profile.

    With ``out`` every table is written (Parquet, large ones by date) and
    later steps read the written table: each is computed once, lineage stays
    short, and an executor loss costs no finished table. Each raw feed is read
    three times: for the records, for the log, and for duplicates or medians. Without
    ``out`` all tables are returned unevaluated and nothing is measured, which suits
    small inputs. Daily tables come in date order, rows without a date last.
    ``dictionary`` describes columns.
    """
    sink = _Sink(spark, out, csv, dictionary)
    points = quality.clean_points(point_raw, require_confidence, expected)
    cleaned = sink.put("tomtom_cleaned_point_time", points.cleaned)
    sink.put("tomtom_daily_availability", quality.daily_availability(cleaned, expected))
    sink.put("tomtom_cleaning_log_by_date", points.cleaning_log)
    removed = quality.duplicates_of(points.valid, cleaned).withColumn("is_duplicate_removed", F.lit(True))
    sink.put("tomtom_duplicate_log", removed)

    segments = quality.clean_segments(segment_raw)
    segment_grid = sink.put("here_cleaned_block_time", grid.segment_block_time(segments.valid))
    sink.put("here_cleaning_log_by_date", segments.cleaning_log)

    point_grid = sink.put("tomtom_block_30min", grid.block_30min(cleaned, config))
    matched = sink.put("matched_tomtom_here_30min", grid.match_block_time(point_grid, segment_grid))
    _whole_tables(sink, cleaned, matched, peak_q)
    return Run(sink.tables, sink.measured)


def _whole_tables(sink: _Sink, cleaned: DataFrame, matched: DataFrame, peak_q: float) -> None:
    """Tables that any new date changes as a whole."""
    sink.put("benchmark_summary", consistency.benchmark_summary(matched, peak_q))
    for name, table in consistency.all_sensitivity(matched, peak_q).items():
        sink.put(name, table)
    sink.put("fig5_intraday_profile_data", profiles.with_zscores(profiles.intraday_profile(cleaned)))
    sink.put("fig5_weekday_weekend_profile_data", profiles.day_type_profile(cleaned))


def table_counts(spark: SparkSession, run: Run) -> DataFrame:
    """``table_name, row_count`` of every written table, as counted by its writers."""
    return spark.createDataFrame([(n, m["rows"]) for n, m in run.measured.items()], "table_name string, row_count bigint")


def run_report(spark: SparkSession, run: Run) -> DataFrame:
    """Records at the main steps of a written run."""
    m = run.measured
    rows = {
        "point_raw": m["tomtom_cleaning_log_by_date"]["raw"], "point_cleaned": m["tomtom_cleaned_point_time"]["rows"],
        "point_duplicates": m["tomtom_duplicate_log"]["rows"], "segment_raw": m["here_cleaning_log_by_date"]["raw"],
        "segment_valid": m["here_cleaning_log_by_date"]["valid"], "matched": m["matched_tomtom_here_30min"]["rows"],
    }
    return spark.createDataFrame([(n, v or 0) for n, v in rows.items()], "table_name string, row_count bigint")


def run_checks(spark: SparkSession, run: Run, expected: int = EXPECTED_PER_DAY, **limits) -> DataFrame:
    """The release checks of a written run, from what its writers measured and the summary table."""
    m = run.measured
    cleaned = m["tomtom_cleaned_point_time"]
    share = cleaned["negative"] / cleaned["rows"] if cleaned["rows"] else None
    counts = run.tables["benchmark_summary"].select(F.concat(F.lit("matched_"), F.col("unit")).alias("label"), F.col("matched_n").alias("n"))
    return checks.checks_of_measures(spark, m["tomtom_daily_availability"]["most_observed"], cleaned["formula_error"], share, counts, expected, **limits)


def touched_dates(*raw: DataFrame) -> DataFrame:
    """``date``: the days of new raw records of either feed; null if some have no readable time."""
    days = [df.select("date") for df in raw]
    out = days[0]
    for d in days[1:]:
        out = out.unionByName(d)
    return out.distinct()


def update_run(
    spark: SparkSession,
    point_raw: DataFrame,
    segment_raw: DataFrame,
    config: DataFrame,
    out: str,
    dates: DataFrame,
    require_confidence: bool = False,
    peak_q: float = PEAK_QUANTILE,
    expected: int = EXPECTED_PER_DAY,
) -> dict[str, DataFrame]:
    """Bring a written run up to date after records of ``dates`` (``date``) came in.

    The raw feeds are all records, old and new. Only those of the given dates are
    cleaned and matched again, and only the folders of these dates are replaced. No
    record counts for two dates, as slots do not cross midnight; lags do, but they are
    taken from the matched table, of which nothing else changes. Small daily
    tables keep their other rows. Summary, sensitivity and profile tables depend
    on all dates and are made anew from the written tables. The result is what
    ``run_measured`` over all records gives.
    """
    out = out.rstrip("/")
    days = stored(dates.select(F.col("date").alias("_day")).distinct(), "touched-dates")

    def of_days(df: DataFrame, how: str) -> DataFrame:
        return df.join(days, df["date"].eqNullSafe(days["_day"]), how)

    def back(name: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{out}/{name}").select(*schema.names)

    def by_date(name: str, df: DataFrame) -> DataFrame:
        replace_partitions(df, f"{out}/{name}", ["date"])
        return back(name, df.schema)

    def daily(name: str, df: DataFrame) -> DataFrame:
        # written beside, then over: the old rows come from the table itself
        whole = stored(of_days(back(name, df.schema), "left_anti").unionByName(df), name)
        write_table(whole.orderBy(F.asc_nulls_last("date")), f"{out}/{name}")
        return back(name, df.schema)

    flagged = of_days(quality.clean_points(point_raw, require_confidence).flagged, "left_semi")
    points = quality.PointTables(flagged, expected)
    tables = {}
    cleaned = tables["tomtom_cleaned_point_time"] = by_date("tomtom_cleaned_point_time", points.cleaned)
    new_cleaned = of_days(cleaned, "left_semi")
    tables["tomtom_daily_availability"] = daily("tomtom_daily_availability", quality.daily_availability(new_cleaned, expected))
    tables["tomtom_cleaning_log_by_date"] = daily("tomtom_cleaning_log_by_date", points.cleaning_log)
    removed = quality.duplicates_of(points.valid, new_cleaned.select(*points.cleaned.columns)).withColumn("is_duplicate_removed", F.lit(True))
    tables["tomtom_duplicate_log"] = by_date("tomtom_duplicate_log", removed)

    segments = quality.SegmentTables(of_days(quality.clean_segments(segment_raw).flagged, "left_semi"))
    segment_grid = tables["here_cleaned_block_time"] = by_date("here_cleaned_block_time", grid.segment_block_time(segments.valid))
    tables["here_cleaning_log_by_date"] = daily("here_cleaning_log_by_date", segments.cleaning_log)

    point_grid = tables["tomtom_block_30min"] = by_date("tomtom_block_30min", grid.block_30min(new_cleaned, config))
    new_matched = grid.match_block_time(of_days(point_grid, "left_semi"), of_days(segment_grid, "left_semi"))
    matched = tables["matched_tomtom_here_30min"] = by_date("matched_tomtom_here_30min", new_matched)
    sink = _Sink(spark, out, False, None)
    _whole_tables(sink, cleaned, matched, peak_q)
    return {**tables, **sink.tables}


def run_files(
    spark: SparkSession, point_path: str, segment_path: str, config_path: str, out: str, **options
) -> dict[str, DataFrame]:
    """``run_all`` on .csv or .parquet inputs."""
    return run_all(
        spark,
        read_table(spark, point_path),
        read_table(spark, segment_path),
        read_point_config(spark, config_path),
        out,
        **options,
    )
