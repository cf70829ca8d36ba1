"""Snapshot merges and change detection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions.keys import content_key, match_key

NATIVE_SHEET = "application/vnd.google-apps.spreadsheet"


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], order: list[str] | None = None) -> DataFrame:
    """The target after an upsert: matched rows take ``update`` from the source, unmatched source rows are added.

    One full join on the keys, so both sides shuffle once. Of several source rows with one key the last in
    ``order`` wins (without an order the greatest); target rows keep columns outside ``update``; columns the
    source lacks are null in added rows. Null keys match nothing and are kept on either side.
    """
    if order is not None:
        last = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        known = F.row_number().over(last) == 1
        for k in keys:
            known = known | F.col(k).isNull()
        source = source.withColumn("_keep", known).where("_keep").drop("_keep")
    s = source.select(*(F.col(c).alias(f"_s_{c}") for c in source.columns), F.lit(True).alias("_in"))
    on = [F.col(k) == F.col(f"_s_{k}") for k in keys]
    both = target.withColumn("_had", F.lit(True)).join(s, on, "full")
    out = []
    for c in target.columns:
        new = F.col(f"_s_{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        if c in update:
            out.append(F.when(F.col("_in"), new).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_had"), F.col(c)).otherwise(new).alias(c))
    return both.select(*out)


def upsert_fixtures(stored: DataFrame, parsed: DataFrame, now: datetime, file_id: Column | None = None) -> DataFrame:
    """Stored fixtures after a delivery: rows known by crew-sensitive key are refreshed and re-opened, others added.

    ``parsed`` has the columns of the fixture table without ids. Duplicate keys in one delivery count once, the
    last row winning. New ids follow the greatest stored one in the order of the keys, so they are the same on every run.
    """
    fresh = parsed.withColumns({"match_key": match_key(), "content_key": content_key()})
    if file_id is not None:
        fresh = fresh.withColumn("file_id", file_id)
    last = W.partitionBy("match_key").orderBy(F.desc("src_file"), F.desc("src_row"))
    fresh = fresh.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    at = F.lit(now).cast("timestamp_ntz")
    fresh = fresh.withColumns({"cancelled_at": F.lit(None).cast("timestamp_ntz"), "cancel_reason": F.lit(None).cast("string"), "created_at": at, "updated_at": at})
    known = fresh.join(stored.select("match_key"), "match_key", "left_semi")
    new = with_ids(fresh.join(stored.select("match_key"), "match_key", "left_anti"), stored, "id", ["match_key"])
    update = [c for c in stored.columns if c in fresh.columns and c not in ("match_key", "created_at")]
    return upsert(stored, known.unionByName(new, allowMissingColumns=True), ["match_key"], update)


def with_ids(new: DataFrame, stored: DataFrame, column: str, order: list[str], buckets: int = 256) -> DataFrame:
    """Number new rows after the greatest stored id, dense and deterministic, without one task for all.

    Rows are bucketed by a hash of the order columns; each bucket is numbered alone and starts after the sizes
    of the buckets before it.
    """
    spread = new.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    top = stored.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top"))
    numbered = spread.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*order)))
    placed = numbered.join(F.broadcast(starts), "_b").crossJoin(F.broadcast(top))
    return placed.withColumn(column, (F.col("_top") + F.col("_start") + F.col("_r")).cast("long")).drop("_b", "_r", "_start", "_top")


def detect_changes(files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """files plus ``process``: which listed files must be read again.

    files: (file_id, mime, md5, modified, ...); known: (file_id, last_md5, known_modified), one row a file. New
    files are read; native sheets when modified later, or when a time is missing; others when their checksum is
    there and differs from the one processed last.
    """
    joined = files.join(known.select("file_id", "last_md5", "known_modified", F.lit(True).alias("_known")), "file_id", "left")
    later = F.coalesce(F.col("modified") > F.col("known_modified"), F.lit(True))
    other = F.coalesce((F.col("md5") != "") & ~F.col("md5").eqNullSafe(F.col("last_md5")), F.lit(False))
    process = F.lit(force) | F.col("_known").isNull() | F.when(F.col("mime") == NATIVE_SHEET, later).otherwise(other)
    return joined.withColumn("process", process).drop("_known", "last_md5", "known_modified")


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name of several event lists or profile tables; columns a part lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def partition_diff(df: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Groups that split (one old key, several new) and that merged (one new key, several old)."""
    pairs = df.where(F.col(old).isNotNull() & F.col(new).isNotNull()).select(old, new).distinct()
    split = pairs.groupBy(old).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    merged = pairs.groupBy(new).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return split, merged


def acquire_lock(state: dict, now: datetime, minutes: int = 15) -> tuple[bool, dict]:
    """Whether a run may start, and the state after: a lock older than its lifetime is taken over."""
    held = state.get("locked_at")
    if held is not None and (now - held).total_seconds() < minutes * 60:
        return False, state
    return True, state | {"locked_at": now}


def release_lock(state: dict, ok: bool, now: datetime) -> dict:
    """Success resets the error count and notes the time; failure counts up."""
    freed = state | {"locked_at": None}
    return freed | ({"errors": 0, "last_success": now} if ok else {"errors": state.get("errors", 0) + 1})


def may_run(state: dict, now: datetime, force: bool = False, seconds: int = 50) -> bool:
    """Runs keep a distance from the last success unless forced."""
    last = state.get("last_success")
    return force or last is None or (now - last).total_seconds() >= seconds
