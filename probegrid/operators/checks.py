"""Release checks over the result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probegrid.functions.scalars import ratio
from probegrid.schema import EXPECTED_PER_DAY


def _check(df: DataFrame, name: Column, value: Column, threshold: float, ok: Column) -> DataFrame:
    return df.select(
        name.alias("check"),
        value.cast("double").alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def release_checks(
    cleaned: DataFrame,
    daily: DataFrame,
    matched: DataFrame,
    expected: int = EXPECTED_PER_DAY,
    max_formula_error: float = 1e-9,
    max_negative_share: float = 0.5,
    min_matched: int = 3,
) -> DataFrame:
    """One row per check: value, threshold and whether it holds."""
    top = daily.agg(F.max("observed_records").alias("v"))
    formula = cleaned.agg(
        F.max("ci_formula_abs_error").alias("e"),
        ratio(F.count_if(F.col("ci_negative_flag")), F.count("*").cast("double")).alias("s"),
    )
    labels = F.array(F.lit("matched_pooled"), F.concat(F.lit("matched_block_"), F.col("block_id")))
    counts = matched.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    parts = [
        _check(top, F.lit("max_daily_observed"), F.col("v"), expected, F.col("v") <= expected),
        formula.select(F.inline(F.array(
            F.struct(
                F.lit("max_ci_formula_error").alias("check"),
                F.col("e").alias("value"),
                F.lit(float(max_formula_error)).alias("threshold"),
                F.coalesce(F.col("e") <= max_formula_error, F.lit(False)).alias("ok"),
            ),
            F.struct(
                F.lit("negative_ci_share").alias("check"),
                F.col("s").alias("value"),
                F.lit(float(max_negative_share)).alias("threshold"),
                F.coalesce(F.col("s") <= max_negative_share, F.lit(False)).alias("ok"),
            ),
        ))),
        _check(counts, F.col("label"), F.col("n"), min_matched, F.col("n") >= min_matched),
    ]
    return reduce(DataFrame.unionByName, parts)


def checks_of_measures(
    spark: SparkSession,
    most_observed: int | None,
    formula_error: float | None,
    negative_share: float | None,
    counts: DataFrame,
    expected: int = EXPECTED_PER_DAY,
    max_formula_error: float = 1e-9,
    max_negative_share: float = 0.5,
    min_matched: int = 3,
) -> DataFrame:
    """The same checks from numbers a run measured while writing; ``counts`` has label and n.

    No table of records is read. A number that is missing fails its check.
    """
    known = [
        ("max_daily_observed", most_observed, expected), ("max_ci_formula_error", formula_error, max_formula_error),
        ("negative_ci_share", negative_share, max_negative_share),
    ]
    rows = [(n, None if v is None else float(v), float(t), v is not None and v <= t) for n, v, t in known]
    fixed = spark.createDataFrame(rows, "check string, value double, threshold double, ok boolean")
    return fixed.unionByName(_check(counts, F.col("label"), F.col("n"), min_matched, F.col("n") >= min_matched))
