"""Reading and writing tables, dimensions and column metadata."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probegrid.schema import CSV_NULL_WORDS, POINT_CONFIG


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a .csv or .parquet table, chosen by suffix.

    CSV columns all arrive as text (no inference pass over the data); the
    usual no-value words become null and later steps parse what they need.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        raw = spark.read.option("header", True).csv(path)
        first, *rest = raw.columns or [""]
        raw = raw.toDF(first.lstrip("﻿"), *rest) if raw.columns else raw
        return raw.select([
            F.when(~F.col(f"`{c}`").isin(CSV_NULL_WORDS), F.col(f"`{c}`")).alias(c) for c in raw.columns
        ])
    raise ValueError(f"cannot read {suffix or 'a file without suffix'}: use .csv or .parquet")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", measures: dict[str, Column] | None = None) -> dict:
    """Write Parquet, one folder per partition value where asked; gives back ``rows`` and the ``measures`` of what was written.

    Rows of one value are sent to a bounded number of writers, so a day gives
    a few files and not one per task, while a heavy day is still split. Measures
    are aggregates taken by the writing tasks themselves, each of which counts once
    however often it runs; the table is not read for them.
    """
    seen = Observation()
    writer_input = df.hint("rebalance", *partition_by) if partition_by else df
    counted = writer_input.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in (measures or {}).items()])
    writer = counted.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return seen.get


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write the partitions that ``df`` has rows of, in place of those of the same values; others stay untouched."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write CSV with a header; parent folders are made by the file system."""
    df.write.mode(mode).option("header", True).csv(path)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """Raise if a dimension is empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"dimension {name} has no rows")
    return df


def _as_schema(raw: DataFrame, ddl: str, name: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"dimension {name} lacks columns {missing}")
    return require_rows(raw.select([F.col(f.name).cast(f.dataType) for f in schema]), name)


def read_dimension(spark: SparkSession, path: str, ddl: str, name: str) -> DataFrame:
    """Read a dimension table with the columns of ``ddl`` and refuse an empty one."""
    return _as_schema(read_table(spark, path), ddl, name)


def read_jdbc_dimension(
    spark: SparkSession, url: str, table: str, ddl: str, properties: dict[str, str] | None = None
) -> DataFrame:
    """Read a dimension from a database the caller already runs."""
    return _as_schema(spark.read.jdbc(url, table, properties=properties or {}), ddl, table)


def default_point_config(spark: SparkSession, points: int = 42, blocks: int = 3) -> DataFrame:
    """Points P01.. laid out along the corridor in equal blocks."""
    if points < 1 or points % blocks:
        raise ValueError("points must be a multiple of blocks")
    n = F.col("id")
    width = max(2, len(str(points)))
    return spark.range(1, points + 1).select(
        F.concat(F.lit("P"), F.lpad(n.cast("string"), width, "0")).alias("point_id"),
        (F.floor((n - 1) / (points // blocks)) + 1).cast("string").alias("block_id"),
        n.cast("int").alias("corridor_order"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
    )


def read_point_config(spark: SparkSession, path: str) -> DataFrame:
    """Point layout from a file; only point_id and block_id are required."""
    raw = read_table(spark, path)
    missing = [c for c in ("point_id", "block_id") if c not in raw.columns]
    if missing:
        raise ValueError(f"point config lacks columns {missing}")
    cols = [
        (F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in T.StructType.fromDDL(POINT_CONFIG)
    ]
    return require_rows(raw.select(cols), "point config")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A data dictionary file: ``variable`` and any further text columns about it."""
    raw = read_table(spark, path)
    if "variable" not in raw.columns:
        raise ValueError("a data dictionary needs a column variable")
    return raw.where("variable is not null")


def with_dictionary(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attach what the dictionary says about each column of ``df`` as column metadata.

    The dictionary is filtered to the columns of ``df`` before it is read.
    """
    wanted = dictionary.where(F.col("variable").isin(df.columns))
    said = {r["variable"]: {k: v for k, v in r.asDict().items() if k != "variable" and v is not None} for r in wanted.toLocalIterator()}
    return df.select([
        F.col(f"`{c}`").alias(c, metadata=said[c]) if c in said else F.col(f"`{c}`") for c in df.columns
    ])


def describe_outputs(df: DataFrame) -> DataFrame:
    """variable, type and description of each column, from its metadata (key: value, sorted by key)."""
    rows = [
        (f.name, f.dataType.simpleString(), "; ".join(f"{k}: {v}" for k, v in sorted(f.metadata.items()) if not k.startswith("__")) or None)
        for f in df.schema
    ]
    return df.sparkSession.createDataFrame(rows, "variable string, type string, description string")
