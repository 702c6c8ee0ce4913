"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probegrid.session import stored

__all__ = ["DOC_KEY", "documents_of", "keyed", "release", "same_key", "sorted_flags", "stored", "strings", "table", "unused"]

#: Names a document row even where doc_id repeats or is null: equal keys mean an equal id and an equal text.
DOC_KEY = ["_id", "_h"]


def documents_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns cannot clash; null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """``_id``, ``_h`` and ``text``."""
    plain = documents_of(docs)
    return plain.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text")


def same_key(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of key columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark deletes them once the driver's references are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to differ from every column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> list[bytes]:
    """The bytes of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def changes(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first: does any of the columns differ from the row before?"""
    n = len(columns[0])
    out = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        if pa.types.is_integer(c.type):
            x = c.to_numpy(zero_copy_only=False)
            out |= x[1:] != x[:-1]
        else:
            out |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def sorted_flags(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple | None]]:
    """Batches of a sorted partition with "starts a new value" for each row, and the last value so far."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        first = tuple(c[0].as_py() for c in columns)
        new = np.concatenate([[first != last], changes(columns)])
        last = tuple(c[-1].as_py() for c in columns)
        yield batch, new, last
