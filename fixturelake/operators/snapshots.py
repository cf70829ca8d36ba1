"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_hash(df: DataFrame, columns: list[str], seed: int = 0) -> Column:
    """Hash of the values as they stand: nulls and array lengths take part, so shifted values differ."""
    parts: list[Column] = [F.lit(seed)] if seed else []
    for c in columns:
        parts += [F.col(c), F.col(c).isNull()]
        if isinstance(df.schema[c].dataType, T.ArrayType):
            parts += [F.size(c), F.transform(c, lambda x: x.isNull())]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def snapshot_changes(df: DataFrame, snap: str, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(snap, key, change_kind, n_before, n_after) for each key added, removed or changed against the snapshot before.

    Rows are read once. Each distinct content of a key (128 bits of row hash) is tagged with the sides it stands on:
    the new side of its own snapshots and the old side of the next ones present. A key is unchanged where every
    content of the old side stands on the new one too and none is new, which is three counts, so no key's contents
    are ever gathered, however many a key has: contents aggregate partially before either shuffle. n_before and
    n_after count distinct contents. Rows delivered twice count once; a key that is null belongs to no record and
    is left out; values and array order are taken as they stand, null equal to null. The first snapshot yields
    nothing; an empty table yields nothing.
    """
    columns = [c for c in df.columns if c not in {snap, key, *ignore}]
    snaps = df.where(F.col(snap).isNotNull()).select(F.col(snap).alias("_at")).distinct()
    # one row a delivery, and there are as many as deliveries: a small table at any size of the data
    order = snaps.agg(F.sort_array(F.collect_set("_at")).alias("_order"))
    hashed = df.where(F.col(key).isNotNull() & F.col(snap).isNotNull()).select(
        F.col(snap).alias("_at"), F.col(key).alias("_key"), row_hash(df, columns).alias("_h"), row_hash(df, columns, 1).alias("_g")
    )
    contents = hashed.groupBy("_key", "_h", "_g").agg(F.sort_array(F.collect_set("_at")).alias("_on"))
    # the sides of a content: (snapshot, stands before, stands after), at most two a delivery
    nexts = F.transform("_on", lambda x: F.get(F.col("_order"), F.array_position("_order", x).cast("int")))
    later = F.filter("_on", lambda x: x > F.col("_order")[0])
    sides = F.transform(
        F.array_distinct(F.concat(later, F.filter(nexts, lambda x: x.isNotNull()))),
        lambda x: F.struct(x.alias("to"), F.array_contains(nexts, x).alias("old"), F.array_contains("_on", x).alias("new")),
    )
    placed = contents.crossJoin(F.broadcast(order)).select("_key", F.explode(sides).alias("_s"))
    one = placed.groupBy(F.col("_s.to").alias(snap), F.col("_key").alias(key)).agg(
        F.count(F.when(F.col("_s.old"), 1)).alias("n_before"), F.count(F.when(F.col("_s.new"), 1)).alias("n_after"),
        F.count(F.when(F.col("_s.old") & F.col("_s.new"), 1)).alias("_both"),
    )
    kind = (
        F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed")
        .when((F.col("_both") < F.col("n_before")) | (F.col("_both") < F.col("n_after")), "changed")
    )
    return one.withColumn("change_kind", kind).where("change_kind IS NOT NULL").select(snap, key, "change_kind", "n_before", "n_after")
