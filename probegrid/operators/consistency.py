"""How well two measures agree: correlation, rank correlation, peak overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probegrid.functions.order_stats import average_rank, interpolate, pooled, ranked_pairs
from probegrid.operators.dedup import distinct_complete
from probegrid.schema import LAG_MINUTES, PEAK_QUANTILE, THRESHOLD_QUANTILES

X = "tomtom_mean_ci_percent"
Y = "here_mean_jam_factor"
MOMENTS = {"avg": "mean", "stddev_samp": "sd", "min": "min", "max": "max"}


def _correlation(a: Column, b: Column) -> Column:
    """Null for a constant side (the built-in ``corr`` would divide by zero)."""
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def consistency_stats(
    df: DataFrame,
    units: list[str],
    x: str = X,
    y: str = Y,
    quantiles: tuple[float, ...] = (PEAK_QUANTILE,),
) -> DataFrame:
    """Per unit and quantile: n, moments, medians, Pearson, Spearman, peak overlap.

    One aggregation over the ranked rows gives everything. A peak is a value
    at or above the interpolated quantile, which lies between two neighbouring
    values: overlap is counted from either neighbour on (``low``, ``high``),
    and the right count is taken once the quantile itself is known.
    """
    q_list = F.array(*[F.lit(float(q)) for q in quantiles])
    rows = ranked_pairs(df, units, x, y).select(
        *units, "x", "y", "n",
        F.explode(q_list).alias("quantile"),
        "x_below", "y_below",
        F.expr("x_below + x_equal").alias("x_upto"),
        F.expr("y_below + y_equal").alias("y_upto"),
        average_rank(F.col("x_below"), F.col("x_equal")).alias("x_rank"),
        average_rank(F.col("y_below"), F.col("y_equal")).alias("y_rank"),
    )
    rows = rows.selectExpr("*", "(n - 1) * quantile as spot", "(n - 1) / 2 as mid")
    # 0-based positions in the sorted unit
    places = {"low": "floor(spot)", "high": "ceil(spot)", "mid_low": "floor(mid)", "mid_high": "ceil(mid)"}
    aggs = [
        F.count("*").alias("matched_n"),
        _correlation(F.col("x"), F.col("y")).alias("pearson"),
        _correlation(F.col("x_rank"), F.col("y_rank")).alias("spearman"),
    ]
    for s in ("x", "y"):
        aggs += [F.expr(f"{fn}({s})").alias(f"{s}_{name}") for fn, name in MOMENTS.items()]
        aggs += [
            F.expr(f"max(case when {s}_below <= {at} and {at} < {s}_upto then {s} end)").alias(f"{s}_at_{name}")
            for name, at in places.items()
        ]
    for i in ("low", "high"):
        for j in ("low", "high"):
            peak_x, peak_y = f"x_upto > {places[i]}", f"y_upto > {places[j]}"
            aggs += [
                F.expr(f"count_if({peak_x} and {peak_y})").alias(f"both_{i}_{j}"),
                F.expr(f"count_if({peak_x} or {peak_y})").alias(f"any_{i}_{j}"),
            ]
    stats = rows.groupBy(*units, "quantile").agg(*aggs)
    share = F.expr("(matched_n - 1) * quantile - floor((matched_n - 1) * quantile)")
    for s in ("x", "y"):
        low, high = F.col(f"{s}_at_low"), F.col(f"{s}_at_high")
        start = F.when(interpolate(low, high, share) <= low, "low").otherwise("high")
        stats = stats.withColumn(f"{s}_from", start)
    chosen = {
        kind: "case " + " ".join(
            f"when x_from = '{i}' and y_from = '{j}' then {kind}_{i}_{j}" for i in ("low", "high") for j in ("low", "high")
        ) + " end"
        for kind in ("both", "any")
    }
    return stats.selectExpr(
        *units,
        "quantile",
        "matched_n",
        *[f"{s}_{m}" for s in ("x", "y") for m in MOMENTS.values()],
        "(x_at_mid_low + x_at_mid_high) / 2 as x_median",
        "(y_at_mid_low + y_at_mid_high) / 2 as y_median",
        "case when matched_n >= 3 then pearson end as pearson_r",
        "case when matched_n >= 3 then spearman end as spearman_rho",
        f"({chosen['both']}) / nullif({chosen['any']}, 0) as peak_overlap_index",
    )


def _one_row_each(df: DataFrame, column: Column, name: str) -> DataFrame:
    """A literal list as rows, without data of its own."""
    return df.sparkSession.range(1).select(F.explode(column).alias(name))


def benchmark_summary(matched: DataFrame, q: float = PEAK_QUANTILE, x: str = X, y: str = Y) -> DataFrame:
    """Pooled and per-block summary; the pooled row is there even without matches."""
    labels = F.array(F.lit("pooled"), F.concat(F.lit("block_"), F.col("block_id").cast("string")))
    stats = consistency_stats(matched.withColumn("unit", F.explode(labels)), ["unit"], x, y, (q,))
    always = _one_row_each(matched, F.array(F.lit("pooled")), "unit")
    return always.join(stats, "unit", "full").select(
        "unit",
        F.coalesce("matched_n", F.lit(0)).alias("matched_n"),
        *[F.col(f"x_{m}").alias(f"tomtom_ci_{m}") for m in ("mean", "median", "sd", "min", "max")],
        *[F.col(f"y_{m}").alias(f"here_jf_{m}") for m in ("mean", "median", "sd", "min", "max")],
        "pearson_r",
        "spearman_rho",
        F.lit(float(q)).alias("peak_overlap_q"),
        "peak_overlap_index",
    )


def sensitivity_threshold(
    matched: DataFrame, quantiles: tuple[float, ...] = THRESHOLD_QUANTILES, x: str = X, y: str = Y
) -> DataFrame:
    """Pooled peak overlap at several quantiles, from one pass."""
    stats = consistency_stats(pooled(matched), ["unit"], x, y, quantiles)
    found = stats.select(F.col("quantile").alias("threshold_quantile"), "matched_n", "peak_overlap_index")
    wanted = _one_row_each(matched, F.array(*[F.lit(float(q)) for q in quantiles]), "threshold_quantile")
    return wanted.join(found, "threshold_quantile", "left").select(
        "threshold_quantile", F.coalesce("matched_n", F.lit(0)).alias("matched_n"), "peak_overlap_index"
    )


def sensitivity_lag(
    matched: DataFrame, lags: tuple[int, ...] = LAG_MINUTES, q: float = PEAK_QUANTILE, x: str = X, y: str = Y
) -> DataFrame:
    """Agreement with the segment side moved in time; one row per lag always.

    All lags share one equi-join on (block, moved slot).
    """
    base = matched.withColumn("block_id", F.col("block_id").cast("string"))
    left = distinct_complete(base, ["block_id", "interval_30min", x])
    right = distinct_complete(base, ["block_id", "interval_30min", y])
    lag_list = F.array(*[F.lit(int(m)) for m in lags])
    moved = right.withColumn("here_shift_minutes", F.explode(lag_list)).withColumn(
        "interval_30min",
        F.col("interval_30min") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("here_shift_minutes"), F.lit(0)),
    )
    joined = left.join(moved, ["block_id", "interval_30min"])
    stats = consistency_stats(joined, ["here_shift_minutes"], x, y, (q,))
    wanted = _one_row_each(matched, lag_list, "here_shift_minutes")
    return wanted.join(stats, "here_shift_minutes", "left").select(
        "here_shift_minutes",
        F.coalesce("matched_n", F.lit(0)).alias("matched_n"),
        "pearson_r",
        "spearman_rho",
        F.lit(float(q)).alias("peak_overlap_q"),
        "peak_overlap_index",
    )


def _by_unit(matched: DataFrame, unit: str, q: float, x: str, y: str) -> DataFrame:
    return consistency_stats(matched, [unit], x, y, (q,)).select(
        unit,
        "matched_n",
        "pearson_r",
        "spearman_rho",
        F.lit(float(q)).alias("peak_overlap_q"),
        "peak_overlap_index",
        F.col("x_mean").alias("tomtom_ci_mean"),
        F.col("y_mean").alias("here_jf_mean"),
    )


def sensitivity_per_block(matched: DataFrame, q: float = PEAK_QUANTILE, x: str = X, y: str = Y) -> DataFrame:
    return _by_unit(matched, "block_id", q, x, y)


def sensitivity_daily(matched: DataFrame, q: float = PEAK_QUANTILE, x: str = X, y: str = Y) -> DataFrame:
    if "date" not in matched.columns:
        matched = matched.withColumn("date", F.to_date("interval_30min"))
    return _by_unit(matched, "date", q, x, y)


def all_sensitivity(matched: DataFrame, q: float = PEAK_QUANTILE) -> dict[str, DataFrame]:
    """The four tables; the threshold study keeps its own fixed quantiles."""
    return {
        "sensitivity_threshold": sensitivity_threshold(matched),
        "sensitivity_lag": sensitivity_lag(matched, q=q),
        "sensitivity_per_block": sensitivity_per_block(matched, q),
        "sensitivity_daily": sensitivity_daily(matched, q),
    }
