"""Exact ranks, percentiles and row numbers that never gather a large group.

Equal values of a unit are counted first, so a frequent value is one row. The
counted values are dealt in order by range partitioning, whose borders Spark
samples from the data: however narrow or wide the values are, a task gets about
as many as any other. The number of the task is stored with the row as its
bucket. Each bucket is sorted on its own, and bucket totals are summed in order.
There is one way for units of every size.

The dealt rows are written to the shared folder, so a later step, or one that
is repeated after an executor loss, sees the same buckets. NaN is the largest
value, as in Spark's own ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probegrid.session import stored


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``bucket``, a whole number that does not fall along ``order``; equal rows share one."""
    return stored(df.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()), "in-order")


def _positions(df: DataFrame, units: list[str], value: str) -> DataFrame:
    """Counted values of each unit in order: ``value, n_equal, bucket, bucket_start, bucket_n, unit_n``.

    A null is kept as a value that counts nothing, so a unit without values has a row.
    """
    counted = df.groupBy(*units, F.col(value).cast("double").alias("value")).agg(F.count(value).alias("n_equal"))
    ordered = in_order(counted, [*units, "value"])
    unit = Window.partitionBy(*units)
    before = unit.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy(*units, "bucket").agg(F.sum("n_equal").alias("bucket_n")).select(
        *units, "bucket", "bucket_n", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("bucket_start"), F.sum("bucket_n").over(unit).alias("unit_n"),
    )
    return ordered.join(totals, [*units, "bucket"])


def _place(positions: DataFrame, units: list[str]) -> DataFrame:
    """Add to every value the number of rows below it in its unit."""
    below = Window.partitionBy(*units, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return positions.select(
        *units, "value", "n_equal",
        (F.col("bucket_start") + F.coalesce(F.sum("n_equal").over(below), F.lit(0))).alias("n_below"),
        "unit_n",
    )


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all ``columns`` present."""
    return df.where(" and ".join(f"`{c}` is not null" for c in columns))


def pooled(df: DataFrame, name: str = "unit") -> DataFrame:
    """All rows as one unit. Exploded and not a literal: the optimizer would
    drop a literal from join keys and leave joins without an equality."""
    return df.withColumn(name, F.explode(F.array(F.lit("pooled"))))


def value_positions(df: DataFrame, units: list[str], value: str) -> DataFrame:
    """One row per unit and distinct value: n_equal, n_below, unit_n.

    The average rank of a value is ``n_below + (n_equal + 1) / 2``.
    """
    return _place(_positions(df.where(F.col(value).isNotNull()), units, value), units)


def ranked_pairs(df: DataFrame, units: list[str], x: str, y: str) -> DataFrame:
    """Complete pairs with x_below, x_equal, y_below, y_equal and n of their unit.

    ``x_below`` counts the unit's rows with a smaller x, ``x_equal`` those
    with the same. ``df`` is read several times: pass a stored table.
    """
    pairs = complete(
        df.select(*units, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), [*units, "x", "y"]
    )
    sides = pairs.select(*units, F.inline(F.array(*[F.struct(F.lit(v).alias("side"), F.col(v).alias("value")) for v in ("x", "y")])))
    placed = value_positions(sides, [*units, "side"], "value")
    # Joined on (unit, value): AQE splits a value that very many rows share.
    ranked = pairs
    for side in ("x", "y"):
        of_side = placed.where(F.col("side") == side).select(
            *units,
            F.col("value").alias(side),
            F.col("n_below").alias(f"{side}_below"),
            F.col("n_equal").alias(f"{side}_equal"),
            *([F.col("unit_n").alias("n")] if side == "x" else []),
        )
        ranked = ranked.join(of_side, [*units, side])
    return ranked


def average_rank(n_below: Column, n_equal: Column) -> Column:
    return n_below + (n_equal + 1) / 2


def interpolate(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation; exact where both ends are the same value."""
    step = high - low
    return F.when(share >= 0.5, high - step * (1 - share)).otherwise(low + step * share)


def percentiles(df: DataFrame, units: list[str], values: list[str], wanted: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles of several measures per unit.

    ``wanted`` names the quantiles. The result has the unit columns, and for
    every measure m its count ``m_n`` and a column ``m_<name>`` per quantile. A
    unit without values has counts of 0 and nulls. All measures share one pass; a
    bucket no quantile falls in is dropped before anything is sorted.
    """
    base = complete(df.select(*units, *[F.col(v).cast("double").alias(v) for v in values]), units)
    keys = [*units, "measure"]
    long = base.select(
        *units,
        F.inline(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).alias("value")) for v in values])),
    )
    spots = {name: f"(unit_n - 1) * {float(q)}D" for name, q in wanted.items()}
    ends = [f"{end}({spot})" for spot in spots.values() for end in ("floor", "ceil")]
    needed = " or ".join(f"(bucket_start <= {p} and {p} < bucket_start + bucket_n)" for p in ends)
    placed = _place(_positions(long, keys, "value").where(f"unit_n = 0 or {needed}"), keys)

    def at(measure: str, position: str) -> str:
        return f"max(case when measure = '{measure}' and n_below <= {position} and {position} < n_below + n_equal then value end)"

    aggs = []
    for v in values:
        aggs.append(F.expr(f"max(case when measure = '{v}' then unit_n end)").alias(f"{v}_n"))
        for name, spot in spots.items():
            aggs.append(F.expr(at(v, f"floor({spot})")).alias(f"{v}_{name}_low"))
            aggs.append(F.expr(at(v, f"ceil({spot})")).alias(f"{v}_{name}_high"))
    found = placed.groupBy(*units).agg(*aggs)
    cols = []
    for v in values:
        cols.append(F.coalesce(f"{v}_n", F.lit(0)).alias(f"{v}_n"))
        for name, q in wanted.items():
            spot = (F.col(f"{v}_n") - 1) * F.lit(float(q))
            cols.append(
                interpolate(F.col(f"{v}_{name}_low"), F.col(f"{v}_{name}_high"), spot - F.floor(spot)).alias(f"{v}_{name}")
            )
    return found.select(*units, *cols)


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Number all rows from 1 in ``order`` without one global sort.

    ``order`` should be unique: rows that are equal in it are numbered in any order.
    """
    tagged = in_order(df, order)
    # one row per bucket, of which there are as many as shuffle partitions
    totals = tagged.groupBy("bucket").agg(F.count("*").alias("bucket_n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("bucket_start")
    )
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return (
        tagged.withColumn("in_bucket", within)
        .join(starts, "bucket")
        .withColumn(name, F.col("bucket_start") + F.col("in_bucket"))
        .drop("bucket", "bucket_start", "in_bucket")
    )
