"""Micro-batches written to tables that are right after every batch.

Each function starts a query that hands its micro-batches to one writer. What a
batch adds goes to a partition of its own, named by the batch id and overwritten
as a whole: a batch that runs again after a failure replaces its rows instead of
adding them twice. Only parts of tables that a batch touches are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from probegrid.functions.scalars import floor_minutes
from probegrid.operators.quality import availability_of_counts
from probegrid.schema import EXPECTED_PER_DAY
from probegrid.sources.payloads import Ingested

COMMITS = "commits"
#: The partition column that names a batch; documents have a ``batch_id`` of their own.
BATCH = "micro_batch"


def start_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start handing every available micro-batch to ``write``; ends when there is no more input."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_batch(df: DataFrame, path: str, batch_id: int, by: list[str] = []) -> None:
    """Write the rows of one batch as its partitions of a table, in place of what an earlier attempt left there."""
    named = df.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, BATCH).parquet(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table of ``put_batch``: its columns, then ``micro_batch``; no rows before the first batch."""
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*known.fields, T.StructField(BATCH, T.LongType())])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(full).parquet(path) if there else spark.createDataFrame([], full)


# --- One stream of documents to three tables ----------------------------------------

def start_ingest(landed: DataFrame, parse: Callable[..., Ingested], out: str, checkpoint: str):
    """Flows, shapes and rejects of landed documents, each in a table below ``out``.

    A document is parsed once; the three tables are written from the parsed rows.
    When all three are there, the batch is entered in the table of commits with its
    counts. ``read_ingested`` shows committed batches only, so a reader sees all
    rows of a batch or none.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        held: list[DataFrame] = []

        def settle(df: DataFrame) -> DataFrame:
            held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return held[-1]

        tables = parse(batch, settle=settle)
        counts = {}
        for name in ("flows", "shapes", "rejects"):
            seen = Observation(name)
            put_batch(getattr(tables, name).observe(seen, F.count(F.lit(1)).alias("rows")), f"{out}/{name}", batch_id)
            counts[name] = seen.get["rows"]
        done = batch.sparkSession.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()])
        put_batch(done, f"{out}/{COMMITS}", batch_id)
        for df in held:
            df.unpersist()

    return start_batches(landed, write, checkpoint)


def read_commits(spark: SparkSession, out: str) -> DataFrame:
    """``flows, shapes, rejects, micro_batch``: rows of each committed batch."""
    return read_batches(spark, f"{out}/{COMMITS}", "flows bigint, shapes bigint, rejects bigint")


def read_ingested(spark: SparkSession, out: str, name: str, schema: T.StructType) -> DataFrame:
    """One of the three tables, committed batches only."""
    done = read_commits(spark, out).select(BATCH)
    return read_batches(spark, f"{out}/{name}", schema).join(done, BATCH, "left_semi").select(*schema.names)


# --- Availability while the day runs --------------------------------------------------

SLOTS = "point_id string, interval_15min timestamp_ntz, date date"


def start_availability(valid: DataFrame, out: str, checkpoint: str, expected: int = EXPECTED_PER_DAY):
    """Observed records per date, brought up to date by every batch.

    ``slots`` holds each point and slot once, under the batch that brought it first;
    ``availability`` holds one row per date. Of both, a batch reads and
    rewrites only dates it has rows of. Order of arrival does not matter
    and nothing is too late. Rows without a date are not counted.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where("date is not null").select("point_id", "interval_15min", "date").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        dates = new.select("date").distinct()
        known = read_batches(spark, f"{out}/slots", SLOTS).where(F.col(BATCH) != batch_id).join(dates, "date", "left_semi")
        same = [new[c].eqNullSafe(known[c]) for c in ("point_id", "interval_15min", "date")]
        put_batch(new.join(known, same[0] & same[1] & same[2], "left_anti"), f"{out}/slots", batch_id, ["date"])
        slots = read_batches(spark, f"{out}/slots", SLOTS).join(dates, "date", "left_semi")
        counted = availability_of_counts(slots.groupBy("date").agg(F.count("*").alias("observed_records")), expected)
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{out}/availability")
        new.unpersist()

    return start_batches(valid, write, checkpoint)


def read_availability(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/availability").select(*schema.names)


# --- Windows that account for every row ------------------------------------------------

AUDIT = "arrived bigint, kept bigint, late bigint, undated bigint, newest timestamp_ntz, limit_time timestamp_ntz"
SUMS = ["speed", "jam_factor", "confidence"]
PARTIALS = "block_id string, interval_30min timestamp_ntz, n bigint, " + ", ".join(f"{c}_sum double, {c}_n bigint" for c in SUMS)


def start_segment_windows(flagged: DataFrame, out: str, checkpoint: str, delay_minutes: int = 30):
    """Segment records per block and half hour, with every record accounted for.

    A record older than the newest time of all earlier batches less the delay is
    late; one without a time is undated. Both go to ``aside`` with their ``fate``. Of the
    kept ones, valid records enter ``partials``, sums and counts that batches add
    to. ``audit`` has a row per batch, in which arrived = kept + late + undated.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_batches(spark, f"{out}/audit", AUDIT).where(F.col(BATCH) < batch_id)
        newest = before.agg(F.max("newest").alias("t")).first().t
        limit = F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(delay_minutes), F.lit(0))
        ts = F.col("timestamp")
        fate = F.when(ts.isNull(), "undated").when(ts < limit, "late").otherwise("kept")
        marked = batch.withColumn("fate", fate).persist(StorageLevel.MEMORY_AND_DISK)
        put_batch(marked.where("fate <> 'kept'"), f"{out}/aside", batch_id)
        sums = [x for c in SUMS for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
        kept = marked.where("fate = 'kept' and is_valid").groupBy("block_id", floor_minutes(ts, 30).alias("interval_30min"))
        put_batch(kept.agg(F.count("*").alias("n"), *sums), f"{out}/partials", batch_id)
        of = lambda name: F.count_if(F.col("fate") == name).alias(name)
        put_batch(marked.agg(F.count("*").alias("arrived"), of("kept"), of("late"), of("undated"), F.max("timestamp").alias("newest"), F.first(limit).alias("limit_time")), f"{out}/audit", batch_id)
        marked.unpersist()

    return start_batches(flagged, write, checkpoint)


def read_audit(spark: SparkSession, out: str) -> DataFrame:
    """What became of the rows of each batch."""
    return read_batches(spark, f"{out}/audit", AUDIT)


def read_aside(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Late and undated rows as they arrived, with ``fate`` and ``micro_batch``."""
    return read_batches(spark, f"{out}/aside", T.StructType([*schema.fields, T.StructField("fate", T.StringType())]))


def read_segment_windows(spark: SparkSession, out: str) -> DataFrame:
    """Means and counts per block and half hour over all batches so far."""
    parts = read_batches(spark, f"{out}/partials", PARTIALS)
    mean = lambda c: (F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_n"), F.lit(0))).alias(f"here_mean_{c}")
    return parts.groupBy("block_id", "interval_30min").agg(*[mean(c) for c in SUMS], F.sum("n").alias("here_record_count"))
