"""Joins and rankings that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is hot when it holds more than one HOT-th of all rows, so there are at most HOT hot keys.
HOT = 500
#: Parts into which each group is split for ranking.
SALTS = 64


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with groups (one row a key, ``size`` = its number of rows) on non-null keys.

    Keys holding more than 1/HOT of all rows (never more than HOT of them) are broadcast; their rows take a salt
    into the shuffle that follows, so they spread over all tasks, and meet nothing there. All other keys are small
    by construction. Rows are read once.
    """
    value = [c for c in groups.columns if c not in keys and c != size]
    total = groups.agg(F.sum(size).alias("_attach_total"))
    marked = groups.crossJoin(F.broadcast(total)).withColumn("_attach_hot", F.col(size) * HOT > F.col("_attach_total")).drop("_attach_total", size)
    hot = marked.where("_attach_hot").select(*keys, F.struct(F.lit(1).alias("_"), *value).alias("_attach_h"))
    cold = marked.where("NOT _attach_hot").select(*keys, F.struct(F.lit(1).alias("_"), *value).alias("_attach_c"), F.lit(0).cast("long").alias("_attach_salt"))
    met = rows.withColumn("_attach_own", F.xxhash64(*rows.columns)).join(F.broadcast(hot), keys, "left")
    met = met.withColumn("_attach_salt", F.when(F.col("_attach_h").isNull(), F.lit(0).cast("long")).otherwise(F.when(F.col("_attach_own") == 0, F.lit(1).cast("long")).otherwise(F.col("_attach_own")))).drop("_attach_own")
    both = met.join(cold, [*keys, "_attach_salt"], "left").withColumn("_attach_g", F.coalesce("_attach_h", "_attach_c")).where("_attach_g IS NOT NULL")
    return both.select(*rows.columns, *(F.col(f"_attach_g.{c}").alias(c) for c in value))


def dense_rank_in(df: DataFrame, group: list[str], order: Column, salt_on: str, out: str, salts: int = SALTS) -> DataFrame:
    """0-based position of each row in its group without holding a group in one task.

    Rows are spread over salts by a hash of ``salt_on``; positions count salt by salt, then by ``order``.
    Deterministic for unique ``salt_on``; the per-salt counts number groups x salts.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*group, "_salt").orderBy(order)) - 1
    return salted.withColumn("_at", local).join(starts, [*group, "_salt"]).withColumn(out, F.col("_start") + F.col("_at")).drop("_salt", "_at", "_start")
