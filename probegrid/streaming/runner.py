"""Running a stream over all available files into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from probegrid.session import work_folder


def start_append(stream: DataFrame, table_path: str, checkpoint: str, partition_by: list[str] | None = None):
    """Start appending a stream to a Parquet table; processes what is there and ends.

    The file sink commits each batch once, so a restart from the checkpoint
    neither loses nor repeats rows.
    """
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).format("parquet").start(table_path)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input and return the resulting table."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    query = start_append(stream, f"{folder}/table", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
