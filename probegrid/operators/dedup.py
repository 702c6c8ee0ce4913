"""One record per point and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probegrid.operators.normalize import MADE_UP

SLOT_KEY = ["point_id", "interval_15min"]


def keep_first(valid: DataFrame, key: list[str] = SLOT_KEY, order: list[str] = ["timestamp", "ingest_seq"]) -> DataFrame:
    """The earliest record of each key.

    ``row_number() = 1`` is planned with a group limit before the shuffle as
    well: each map task sends at most one record per key, so a slot with a
    very large number of copies does not arrive whole in one task. What the
    order leaves open is decided by the content, so a repeated run, and a second
    use of the same plan, keep the same records.
    """
    w = Window.partitionBy(*key).orderBy(*order, F.xxhash64(*valid.columns), *[c for c in valid.columns if c not in (*key, *order)])
    return valid.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def duplicates_of(valid: DataFrame, kept: DataFrame) -> DataFrame:
    """The valid records that ``keep_first`` removed; with the kept ones they are all of ``valid``.

    The difference of two bags: valid records count +1, kept ones -1, and
    equal records (missing values included) are added up, in map tasks first. What
    is left over is given out as often as it counts. A sequence number that was
    made up on reading is not compared and null in the result.
    """
    made_up = [f for f in valid.schema if f.metadata.get(MADE_UP)]
    columns = [c for c in valid.columns if c not in {f.name for f in made_up}]
    signed = valid.select(*columns, F.lit(1).alias("_n")).unionByName(kept.select(*columns, F.lit(-1).alias("_n")))
    rest = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n > 0")
    # in two steps, so that a record with very many copies needs no array of that length
    most = 10_000
    chunks = rest.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / most))))
    size = F.least(F.lit(most).cast("bigint"), F.col("_n") - F.col("_chunk") * most).cast("int")
    lost = [F.lit(None).cast(f.dataType).alias(f.name) for f in made_up]
    return chunks.select(*columns, *lost, F.explode(F.array_repeat(F.lit(True), size)).alias("_copy")).select(*valid.columns)


def distinct_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` without any null."""
    return df.select(*columns).dropna().dropDuplicates()
