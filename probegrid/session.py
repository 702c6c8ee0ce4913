"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "probegrid", master: str | None = None, partitions: int = 2000, **conf: str) -> SparkSession:
    """A session with the settings this library is planned for.

    AQE coalesces small shuffles and splits skewed joins, so ``partitions``, the
    number of shuffle partitions, is meant for the largest shuffle of a run and
    left to AQE to reduce. Stateful streams keep the number they start with.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a session in one local process may fall back to a temporary folder: on a
    cluster, also one of local processes, the executors would not share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/probegrid/{purpose}-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix=f"probegrid-{purpose}-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared working folder and read it back.

    For a table several later steps read: it is computed once, its lineage
    ends in files, and losing an executor loses none of it.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(f"{path}/{name}")
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")
