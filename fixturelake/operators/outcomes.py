"""What becomes of existing assignments after a delivery, behind valves against mass changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions.days import started
from fixturelake.functions.keys import CREWS, crew_size, everyone
from fixturelake.functions.namerule import cell_match
from fixturelake.functions.text import trim

#: A batch of cancellations is unsafe from this many on, and only above this share of all assignments.
VALVE_LEAST, VALVE_SHARE = 25, 0.4
#: Rows may vanish from a file up to this share.
MISSING_SHARE = 0.5


def cancellation_safe(n: Column, total: Column) -> Column:
    share = F.when(total > 0, n / F.when(total > 0, total)).otherwise(F.lit(1.0))
    return ~((n >= VALVE_LEAST) & (share > VALVE_SHARE))


def listed_in(pairs: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """pairs(key..., row_id, name_in_sheet, first_name, last_name) whose person is in the crew of row row_id.

    The cell agrees when trimmed and lower-cased, or the profile's name fits a crew entry by the name rule. Crew
    entries are exploded once and met on the row; equal cells are settled there, the rule sees only the rest.
    """
    entries = rows.select(F.col("id").alias("row_id"), F.explode(everyone()).alias("cell")).distinct()
    met = pairs.join(entries, "row_id").withColumn("_same", F.lower(trim(F.col("cell"))) == F.lower(trim(F.col("name_in_sheet"))))
    named = F.coalesce(F.col("first_name"), F.lit("")) != ""
    same = met.where("_same").select(*key, "row_id").distinct()
    rest = met.where(~F.coalesce(F.col("_same"), F.lit(False)) & named).join(same, [*key, "row_id"], "left_anti")
    ruled = rest.where(cell_match("cell", "first_name", "last_name")["kind"].isNotNull()).select(*key, "row_id").distinct()
    return same.unionByName(ruled)


def canonical_in_pool(rows: DataFrame) -> DataFrame:
    """(content_key, canonical_id) of rows (id, content_key, in_file, crew columns): rows in the file go first, then larger crew, then larger id."""
    best = F.max_by("id", F.struct(F.coalesce("in_file", F.lit(False)), crew_size().alias("n"), F.col("id")))
    return rows.where("content_key IS NOT NULL").groupBy("content_key").agg(best.alias("canonical_id"))


def decide(assignments: DataFrame, rows: DataFrame, file_keys: DataFrame, moved_keys: DataFrame, now: datetime) -> DataFrame:
    """assignments plus outcome and to_match_id.

    assignments: (id, user_id, match_id, name_in_sheet, first_name, last_name) over rows (the active fixtures,
    with in_file telling whether a row is in the file as it stands). file_keys and moved_keys: content_key, those
    in this file and those only in other active files. Outcomes: KEPT, ROW_SHIFTED, CANCELLED, MOVED,
    EXPIRED_WINDOW; begun fixtures are never cancelled; a null content key is kept.
    """
    own = rows.select(F.col("id").alias("match_id"), "content_key", "date_text", "time_text")
    a = assignments.join(own, "match_id")
    flag = lambda df, name: df.select("content_key").where("content_key IS NOT NULL").distinct().withColumn(name, F.lit(True))
    a = a.join(flag(file_keys, "_here"), "content_key", "left").join(flag(moved_keys, "_moved"), "content_key", "left")
    a = a.join(canonical_in_pool(rows), "content_key", "left")
    asked = a.where("_here AND canonical_id IS NOT NULL").select("id", F.col("canonical_id").alias("row_id"), "name_in_sheet", "first_name", "last_name")
    there = listed_in(asked, rows, ["id"]).select("id", F.lit(True).alias("_listed")).distinct()
    a = a.join(there, "id", "left")
    begun = started(F.col("date_text"), F.col("time_text"), now)
    outcome = (
        F.when(F.col("content_key").isNull(), "KEPT")
        .when(F.col("_here").isNull(), F.when(F.col("_moved"), "MOVED").when(begun, "EXPIRED_WINDOW").otherwise("CANCELLED"))
        .when(F.col("canonical_id").isNull(), "KEPT")
        .when(F.col("_listed"), F.when(F.col("match_id") == F.col("canonical_id"), "KEPT").otherwise("ROW_SHIFTED"))
        .when(begun, "EXPIRED_WINDOW").otherwise("CANCELLED")
    )
    out = a.withColumn("outcome", outcome)
    return out.select(*assignments.columns, "content_key", "outcome", F.when(F.col("outcome") == "ROW_SHIFTED", F.col("canonical_id")).alias("to_match_id"))


def apply_outcomes(decisions: DataFrame, assignments: DataFrame, rows: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """New snapshots of assignments and rows, and the events: cancelled, shifted, safe.

    An unsafe batch changes nothing at all. Shifted assignments move to their row; where the user has one there
    already, that one stays and takes over paid_at if it lacks it. Cancelled ones go; rows left without any
    assignment are cancelled, with a reason that tells withdrawal from a changed crew.
    """
    totals = decisions.agg(F.count(F.when(F.col("outcome") == "CANCELLED", 1)).alias("n"), F.count(F.lit(1)).alias("total"))
    safe = totals.select(cancellation_safe(F.col("n"), F.col("total")).alias("safe"))
    d = decisions.crossJoin(F.broadcast(safe))
    outcome = F.when(F.col("safe"), F.col("outcome")).otherwise("KEPT")
    d = d.select(F.col("id"), outcome.alias("outcome"), "to_match_id", "content_key", F.col("match_id").alias("from_match_id"))
    moved = assignments.join(d, "id", "left").where(F.coalesce(F.col("outcome"), F.lit("KEPT")) != "CANCELLED")
    target = F.when(F.col("outcome") == "ROW_SHIFTED", F.col("to_match_id")).otherwise(F.col("match_id"))
    moved = moved.withColumns({"_old": F.col("match_id"), "match_id": target})
    # of several on one row and user the one that was there stays, then the smallest id
    pick = W.partitionBy("user_id", "match_id", F.when(F.col("user_id").isNull(), F.col("id")))
    first = F.row_number().over(pick.orderBy(F.col("_old") != F.col("match_id"), "id"))
    paid = F.first("paid_at", ignorenulls=True).over(pick.orderBy(F.col("_old") != F.col("match_id"), "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    kept = moved.withColumns({"_r": first, "paid_at": paid}).where("_r = 1").select(*assignments.columns)
    touched = d.where("outcome IN ('CANCELLED', 'ROW_SHIFTED')").groupBy(F.col("from_match_id").alias("id")).agg(F.bool_and(F.col("outcome") == "CANCELLED").alias("_pure"))
    emptied = touched.join(kept.select(F.col("match_id").alias("id")), "id", "left_anti")
    reason = F.when(F.col("_pure"), "withdrawn").otherwise("crew updated")
    new_rows = rows.join(emptied, "id", "left").withColumns({
        "cancel_reason": F.when(F.col("_pure").isNotNull() & F.col("cancelled_at").isNull(), reason).otherwise(F.col("cancel_reason")),
        "cancelled_at": F.when(F.col("_pure").isNotNull(), F.coalesce("cancelled_at", F.lit(now).cast("timestamp_ntz"))).otherwise(F.col("cancelled_at")),
    }).select(*rows.columns)
    return {
        "assignments": kept, "rows": new_rows, "safe": safe,
        "cancelled": d.where("outcome = 'CANCELLED'"), "shifted": d.where("outcome = 'ROW_SHIFTED'"),
    }


def cancel_missing(rows: DataFrame, current_keys: DataFrame, assigned: DataFrame, now: datetime) -> DataFrame:
    """rows with those cancelled that vanished from their file: future ones without assignments, if at most half vanished.

    rows: active and cancelled fixtures with match_key and src_file; current_keys: match_key; assigned: match_id.
    """
    active_future = F.col("cancelled_at").isNull() & ~started(F.col("date_text"), F.col("time_text"), now)
    here = current_keys.select("match_key").distinct().withColumn("_here", F.lit(True))
    busy = assigned.groupBy(F.col("match_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    marked = rows.join(here, "match_key", "left").join(busy, "id", "left").withColumn("_open", active_future)
    per_file = marked.where("_open").groupBy("src_file").agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("_here").isNull(), 1)).alias("_gone"))
    ok = per_file.where(F.col("_gone") <= MISSING_SHARE * F.col("_all")).select("src_file", F.lit(True).alias("_ok"))
    marked = marked.join(ok, "src_file", "left")
    hit = F.col("_open") & F.col("_here").isNull() & F.col("_n").isNull() & F.coalesce(F.col("_ok"), F.lit(False))
    return marked.withColumns({
        "cancel_reason": F.when(hit, "not in file").otherwise(F.col("cancel_reason")),
        "cancelled_at": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("cancelled_at")),
    }).select(*rows.columns)


def moved_keys(rows: DataFrame, file_keys: DataFrame, file: Column) -> DataFrame:
    """Content keys missing from a file that are active in another one."""
    elsewhere = rows.where(F.col("cancelled_at").isNull() & F.col("content_key").isNotNull() & ~file.eqNullSafe(F.col("src_file")))
    return elsewhere.select("content_key").distinct().join(file_keys.select("content_key").distinct(), "content_key", "left_anti")


def key_sides(before: DataFrame, after: DataFrame, key: str = "content_key") -> DataFrame:
    """(key, side): keys that are gone, new or in both of two deliveries; null keys are in neither."""
    tag = lambda df, k: df.where(F.col(key).isNotNull()).select(key, F.lit(k).alias("_side"))
    seen = tag(before, 1).unionByName(tag(after, 2)).groupBy(key).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    return seen.select(key, F.when(F.col("_lo") < F.col("_hi"), "both").when(F.col("_lo") == 1, "gone").otherwise("new").alias("side"))


__all__ = ["CREWS", "apply_outcomes", "cancel_missing", "canonical_in_pool", "cancellation_safe", "decide", "key_sides", "listed_in", "moved_keys"]
