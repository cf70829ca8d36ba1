"""Session helpers: reading tables, durable cuts of lineage, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to broadcast.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fixturelake-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files fill fewer of them; a table with more parts than cores is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most that many rows; reads no more than most + 1 of them."""
    return df.limit(most + 1).count() <= most


def broadcast_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the size is proven; beyond it the join shuffles and AQE splits skew."""
    return F.broadcast(df) if small_enough(df, most) else df
