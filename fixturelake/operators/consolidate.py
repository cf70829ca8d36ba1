"""Active rows that share an identity consolidated onto a canonical one, and the family of repairs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions.days import parse_day
from fixturelake.functions.keys import content_key, crew_size, everyone, is_nameless
from fixturelake.functions.text import has_letter, is_placeholder
from fixturelake.operators.merge import partition_diff
from fixturelake.operators.outcomes import listed_in
from fixturelake.session import broadcast_checked, durable


def active(rows: DataFrame) -> DataFrame:
    return rows.where("cancelled_at IS NULL")


def duplicate_groups(rows: DataFrame, key: str = "content_key") -> DataFrame:
    """(key, n) of keys with two rows or more; null keys form no group."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def canonical_rows(rows: DataFrame, key: str = "content_key", placeholders_last: bool = False) -> DataFrame:
    """(key, canonical_id): largest crew, then latest created_at, then smallest id; optionally rows of unknown teams last."""
    real = ~is_placeholder(F.col("match_name")) if placeholders_last else F.lit(True)
    rank = F.struct(real.alias("r"), crew_size().alias("n"), F.col("created_at"), (-F.col("id")).alias("i"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("id", rank).alias("canonical_id"))


def consolidation_plan(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """(content_key, canonical_id, assignment_id, user_id, from_row_id, action) for assignments off the canonical row.

    rows: active fixtures; assignments: (id, user_id, match_id, name_in_sheet, first_name, last_name). Keys with
    two rows are found first and only their rows are read wide. DELETE_DUPE where the user is on the canonical
    row already, MOVE where its crew names the person, DELETE_ON_SIBLING where another row of the group does,
    AMBIGUOUS otherwise; two stale rows that each name the other's person are both siblings.
    """
    groups = duplicate_groups(rows)
    wide = rows.join(groups.select("content_key"), "content_key", "left_semi")
    best = canonical_rows(wide)
    member = wide.select("content_key", F.col("id").alias("row_id")).join(best, "content_key")
    held = assignments.join(member.withColumnRenamed("row_id", "match_id"), "match_id")
    on_best = held.where("match_id = canonical_id AND user_id IS NOT NULL").select("content_key", "user_id", F.lit(True).alias("_dupe")).distinct()
    off = held.where("match_id <> canonical_id").join(on_best, ["content_key", "user_id"], "left")
    asked = off.where("_dupe IS NULL").select("id", "content_key", "match_id", "name_in_sheet", "first_name", "last_name")
    pairs = asked.join(member.select("content_key", "row_id", "canonical_id"), "content_key").where("row_id <> match_id")
    seen = listed_in(pairs.select("id", "row_id", "name_in_sheet", "first_name", "last_name"), wide, ["id"])
    where = seen.join(pairs.select("id", "row_id", "canonical_id"), ["id", "row_id"]).groupBy("id").agg(F.bool_or(F.col("row_id") == F.col("canonical_id")).alias("_on_best"))
    action = F.when(F.col("_dupe"), "DELETE_DUPE").when(F.col("_on_best"), "MOVE").when(~F.col("_on_best"), "DELETE_ON_SIBLING").otherwise("AMBIGUOUS")
    return off.join(where, "id", "left").select("content_key", "canonical_id", F.col("id").alias("assignment_id"), "user_id", F.col("match_id").alias("from_row_id"), action.alias("action"))


def apply_consolidation(plan: DataFrame, assignments: DataFrame, rows: DataFrame, now: datetime, removals: bool = False, dry_run: bool = False) -> dict[str, DataFrame]:
    """New snapshots, an undo log and counters. Rows off the canonical one are cancelled once no assignment is left on them."""
    plan = durable(plan)  # asked for six times below
    undo = assignments.join(plan.select(F.col("assignment_id").alias("id"), "action", "canonical_id"), "id")
    counters = plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    if dry_run:
        return {"assignments": assignments, "rows": rows, "undo": undo, "counters": counters}
    gone = ["DELETE_DUPE", "DELETE_ON_SIBLING"] + (["AMBIGUOUS"] if removals else [])
    p = plan.select(F.col("assignment_id").alias("id"), "action", "canonical_id")
    moved = assignments.join(p, "id", "left").where(~F.coalesce(F.col("action"), F.lit("")).isin(*gone))
    moved = moved.withColumn("match_id", F.when(F.col("action") == "MOVE", F.col("canonical_id")).otherwise(F.col("match_id")))
    w = W.partitionBy("user_id", "match_id", F.when(F.col("user_id").isNull(), F.col("id"))).orderBy(F.coalesce(F.col("action"), F.lit("")) == "MOVE", "id")
    kept = durable(moved.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*assignments.columns))
    stale = plan.select(F.col("from_row_id").alias("id")).distinct().join(kept.select(F.col("match_id").alias("id")), "id", "left_anti").withColumn("_stale", F.lit(True))
    hit = F.col("_stale") & F.col("cancelled_at").isNull()
    new_rows = rows.join(stale, "id", "left").withColumns({
        "cancel_reason": F.when(hit, "consolidated").otherwise(F.col("cancel_reason")),
        "cancelled_at": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("cancelled_at")),
    }).select(*rows.columns)
    return {"assignments": kept, "rows": new_rows, "undo": undo, "counters": counters}


def slot() -> list[Column]:
    return [F.col(c) for c in ("date_text", "time_text", "venue")]


def slot_duplicates(rows: DataFrame) -> DataFrame:
    """(date_text, time_text, venue, n_keys, canonical_id): slots whose active rows carry several identities.

    One representative per identity; the canonical one has known teams, the largest crew, the latest creation.
    """
    reps = canonical_rows(active(rows)).join(rows.select("id", "match_name", "created_at", *[c for c in rows.columns if c in ("date_text", "time_text", "venue")], crew_size().alias("_n")), F.col("canonical_id") == F.col("id"))
    real = ~is_placeholder(F.col("match_name"))
    rank = F.struct(real.alias("r"), F.col("_n"), F.col("created_at"), (-F.col("id")).alias("i"))
    grouped = reps.where("date_text IS NOT NULL AND time_text IS NOT NULL AND venue IS NOT NULL").groupBy("date_text", "time_text", "venue")
    return grouped.agg(F.count(F.lit(1)).alias("n_keys"), F.max_by("id", rank).alias("canonical_id")).where("n_keys > 1")


def slot_moves(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """Repair of slot duplicates: assignments of the other rows of a slot whose person the canonical row names."""
    best = slot_duplicates(rows).select("date_text", "time_text", "venue", "canonical_id")
    others = active(rows).join(best, ["date_text", "time_text", "venue"]).where("id <> canonical_id").select(F.col("id").alias("match_id"), "canonical_id")
    asked = assignments.join(others, "match_id").select("id", "user_id", "match_id", F.col("canonical_id").alias("row_id"), "name_in_sheet", "first_name", "last_name")
    return asked.join(listed_in(asked.select("id", "row_id", "name_in_sheet", "first_name", "last_name"), active(rows), ["id"]), ["id", "row_id"], "left_semi").select("id", "user_id", "match_id", F.col("row_id").alias("to_match_id"))


def renamed_moves(assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """assignments moved along a list of (from_id, to_id), one pair a from_id; a short list is broadcast, a longer one joined by shuffle."""
    p = broadcast_checked(pairs.select(F.col("from_id").alias("match_id"), "to_id"), 10_000)
    return assignments.join(p, "match_id", "left").withColumn("match_id", F.coalesce("to_id", "match_id")).select(*assignments.columns)


def wrongly_cancelled(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """(assignment_id, from_row_id, to_row_id): assignments on cancelled rows that have an active sibling of one identity."""
    alive = canonical_rows(active(rows)).withColumnRenamed("canonical_id", "to_row_id")
    dead = rows.where("cancelled_at IS NOT NULL AND content_key IS NOT NULL").select(F.col("id").alias("match_id"), "content_key")
    return assignments.join(dead, "match_id").join(alive, "content_key").select(F.col("id").alias("assignment_id"), F.col("match_id").alias("from_row_id"), "to_row_id")


def shifted_groups(rows: DataFrame) -> DataFrame:
    """Nameless slots with two cancelled rows or more: counts, and the names on cancelled rows that no active one has."""
    names = F.filter(everyone(), has_letter)
    grouped = rows.where(is_nameless()).groupBy(*slot()).agg(
        F.count(F.when(F.col("cancelled_at").isNotNull(), 1)).alias("n_cancelled"), F.count(F.when(F.col("cancelled_at").isNull(), 1)).alias("n_active"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("cancelled_at").isNotNull(), names)))).alias("_c"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("cancelled_at").isNull(), names)))).alias("_a"),
    )
    return grouped.where("n_cancelled >= 2").select("date_text", "time_text", "venue", "n_cancelled", "n_active", F.array_sort(F.array_except("_c", "_a")).alias("lost_names"))


def reactivate_nameless(rows: DataFrame, assignments: DataFrame, now: datetime) -> DataFrame:
    """rows with one cancelled row re-opened per nameless identity that has no active row: largest crew, then latest.

    Identities with a paid assignment on any row are left alone, in plans as well as when applied.
    """
    paid = assignments.where("paid_at IS NOT NULL").select(F.col("match_id").alias("id")).distinct()
    keyed = rows.where(is_nameless() & F.col("content_key").isNotNull())
    skip = keyed.join(paid, "id", "left_semi").select("content_key").distinct()
    dead = keyed.join(active(keyed).select("content_key").distinct(), "content_key", "left_anti").join(skip, "content_key", "left_anti")
    rank = F.struct(crew_size().alias("n"), F.col("updated_at"), (-F.col("id")).alias("i"))
    pick = dead.groupBy("content_key").agg(F.max_by("id", rank).alias("id")).select("id", F.lit(True).alias("_open"))
    return rows.join(pick, "id", "left").withColumns({
        "cancelled_at": F.when(F.col("_open").isNull(), F.col("cancelled_at")), "cancel_reason": F.when(F.col("_open").isNull(), F.col("cancel_reason")),
        "updated_at": F.when(F.col("_open"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
    }).select(*rows.columns)


def backfill_keys(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with recomputed content keys, and the groups that split or merged by it."""
    both = rows.withColumn("_new", content_key())
    split, merged = partition_diff(both, "content_key", "_new")
    return both.drop("content_key").withColumnRenamed("_new", "content_key").select(*rows.columns), split, merged


def backfill_days(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with missing days read from the text, and those that stay unreadable."""
    filled = rows.withColumn("match_date", F.coalesce("match_date", parse_day(F.col("date_text"))))
    return filled, filled.where("match_date IS NULL").select("id", "date_text")
