import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from probegrid.functions.order_stats import in_order, percentiles, row_numbers, value_positions
from probegrid.operators.consistency import consistency_stats

QS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.85, "e": 1.0}


def frame(seed, n=400, hot=0.4):
    """Few units, one with a large share; ties, negatives, nulls, a frequent value."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        unit = "hot" if r.random() < hot else f"u{r.randrange(6)}"
        x = None if r.random() < 0.05 else 0.0 if r.random() < 0.3 else round(r.uniform(-50, 900), r.choice([0, 2]))
        y = None if r.random() < 0.05 else float(r.randrange(12)) if r.random() < 0.5 else r.gauss(0, 1e-3)
        rows.append((unit, x, y))
    rows += [("one", 1.5, 2.5), ("two", 1.0, 1.0), ("two", 2.0, 3.0), ("flat", 7.0, 1.0), ("flat", 7.0, 2.0), ("flat", 7.0, 4.0)]
    return pd.DataFrame(rows, columns=["unit", "x", "y"])


def spark_frame(spark, pdf):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "unit string, x double, y double")


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles(spark, seed):
    pdf = frame(seed)
    got = percentiles(spark_frame(spark, pdf), ["unit"], ["x", "y"], QS).collect()
    assert len(got) == pdf.unit.nunique()
    for row in got:
        part = pdf[pdf.unit == row.unit]
        for v in ("x", "y"):
            values = part[v].dropna()
            assert row[f"{v}_n"] == len(values)
            for name, q in QS.items():
                assert row[f"{v}_{name}"] == pytest.approx(values.quantile(q), rel=1e-12, abs=1e-12)


def overlap(part, q):
    a, b = part.x >= part.x.quantile(q), part.y >= part.y.quantile(q)
    return (a & b).sum() / (a | b).sum()


@pytest.mark.parametrize("seed", [3, 4])
def test_consistency_equals_pandas(spark, seed):
    pdf = frame(seed)
    quantiles = (0.5, 0.85, 0.95)
    got = consistency_stats(spark_frame(spark, pdf), ["unit"], "x", "y", quantiles).collect()
    complete = pdf.dropna()
    assert len(got) == complete.unit.nunique() * len(quantiles)
    for row in got:
        part = complete[complete.unit == row.unit]
        assert row.matched_n == len(part)
        assert row.x_median == pytest.approx(part.x.median())
        assert row.x_mean == pytest.approx(part.x.mean())
        assert row.peak_overlap_index == pytest.approx(overlap(part, row.quantile))
        if len(part) < 3 or part.x.nunique() == 1:
            assert row.pearson_r is None and row.spearman_rho is None
        else:
            assert row.pearson_r == pytest.approx(part.x.corr(part.y), abs=1e-9)
            assert row.spearman_rho == pytest.approx(part.x.rank().corr(part.y.rank()), abs=1e-9)
        if len(part) == 1:
            assert row.x_sd is None


def test_units_without_values_and_nan(spark):
    nan = float("nan")
    rows = [("none", None), ("none", None), ("nan", 1.0), ("nan", 2.0), ("nan", nan), ("all", nan)]
    df = spark.createDataFrame(rows, "unit string, x double")
    got = {r.unit: r for r in percentiles(df, ["unit"], ["x"], {"m": 0.5}).collect()}
    built_in = {r.unit: r.m for r in df.groupBy("unit").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
    assert got["none"].x_n == 0 and got["none"].x_m is None is built_in["none"]
    assert got["nan"].x_m == built_in["nan"] == 2.0
    assert got["nan"].x_n == 3 and got["all"].x_m != got["all"].x_m


@pytest.mark.parametrize("first, step", [(0.0, 1e-9), (1e10, 1.0), (-5.0, 1e-3)])
def test_buckets_follow_the_data(spark, first, step):
    """However narrow or far out the values are, they are dealt over many buckets in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).selectExpr(f"{first}D + id * {step}D as x")
        ordered = in_order(df, ["x"])
        spans = ordered.groupBy("bucket").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("bucket").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spans) == 8 and all(p.b < q.a for p, q in zip(spans, spans[1:]))


def test_positions(spark):
    df = spark_frame(spark, frame(5))
    got = {(r.unit, r.value): (r.n_below, r.n_equal, r.unit_n) for r in value_positions(df, ["unit"], "x").collect()}
    pdf = frame(5).dropna(subset=["x"])
    for (unit, x), (below, equal, n) in got.items():
        part = pdf[pdf.unit == unit].x
        assert (below, equal, n) == ((part < x).sum(), (part == x).sum(), len(part))


def test_row_numbers(spark):
    df = spark.range(5000).withColumn("h", F.md5(F.col("id").cast("string")))
    rows = row_numbers(df, ["h", "id"], "n").collect()
    assert sorted(r.n for r in rows) == list(range(1, 5001))
    assert [r.h for r in sorted(rows, key=lambda r: r.n)] == sorted(r.h for r in rows)
