"""Whole runs as pure functions: (stored snapshots, a delivery, now) -> (new snapshots, events)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixturelake.functions.days import in_season, parse_day, season_cutoff, started
from fixturelake.functions.keys import content_key, match_key
from fixturelake.functions.text import collapse, upper_tr
from fixturelake.operators import consolidate, merge, notices, outbox, outcomes, resolve, sheets
from fixturelake.session import durable


def run_delivery(cells: DataFrame, store: dict[str, DataFrame], now: datetime, cutoff: date | None = None) -> dict[str, DataFrame]:
    """A changed file's way into the store: parse, cut off, upsert, resolve names, decide, apply, cancel what vanished.

    store: rows, assignments, profiles, users. ``cells`` holds the files that changed (merge.detect_changes).
    """
    parsed = sheets.group_ordinal(sheets.parse_cells(cells), ["src_row"]).withColumn("match_date", parse_day(F.col("date_text")))
    # each step feeds several later ones: its result is cut off durably, so nothing is planned or computed twice
    parsed = durable(parsed.where(in_season(F.col("match_date"), cutoff or season_cutoff(now.date()))))
    rows = durable(merge.upsert_fixtures(store["rows"], parsed, now))
    people = resolve.active_profiles(store["profiles"], store["users"])
    here = durable(parsed.select(content_key().alias("content_key"), match_key().alias("match_key"), "src_file"))
    current = consolidate.active(rows).join(here.select("match_key").distinct(), "match_key", "left_semi")
    had = store["assignments"].where("user_id IS NOT NULL").join(store["rows"].select(F.col("id").alias("match_id"), "content_key"), "match_id").select("user_id", "content_key", "created_at")
    built = durable(resolve.build_assignments(current, people, had))
    new = built.withColumns({"created_at": F.lit(now).cast("timestamp_ntz"), "paid_at": F.lit(None).cast("timestamp_ntz")}).drop("is_new")
    known = new.join(store["assignments"].select("user_id", "match_id"), ["user_id", "match_id"], "left_semi")
    fresh = merge.with_ids(new.join(store["assignments"].select("user_id", "match_id"), ["user_id", "match_id"], "left_anti"), store["assignments"], "id", ["user_id", "match_id"])
    assignments = durable(merge.upsert(store["assignments"], known.unionByName(fresh, allowMissingColumns=True), ["user_id", "match_id"], ["role", "name_in_sheet"]))

    touched = consolidate.active(store["rows"]).join(here.select("src_file").distinct(), "src_file", "left_semi").select("id")
    gone = outcomes.key_sides(store["rows"].join(here.select("src_file").distinct(), "src_file", "left_semi"), here).where("side = 'gone'").select("content_key")
    moved = consolidate.active(rows).join(here.select("src_file").distinct(), "src_file", "left_anti").select("content_key").distinct().join(gone, "content_key", "left_semi")
    named = assignments.join(people.groupBy("user_id").agg(F.min(F.struct("first_name", "last_name")).alias("n")).select("user_id", "n.*"), "user_id", "left")
    checked = named.join(touched.select(F.col("id").alias("match_id")), "match_id", "left_semi")
    flagged = consolidate.active(rows).join(here.select("match_key").distinct().withColumn("in_file", F.lit(True)), "match_key", "left")
    decided = durable(outcomes.decide(checked, flagged, here, moved, now))
    done = outcomes.apply_outcomes(decided, assignments, rows, now)
    final = outcomes.cancel_missing(done["rows"], here, done["assignments"], now)
    events = built.where("is_new").select("user_id", "match_id")
    return {"rows": final, "assignments": done["assignments"], "assigned": events, "cancelled": done["cancelled"], "shifted": done["shifted"], "safe": done["safe"]}


def run_consolidation(store: dict[str, DataFrame], now: datetime, dry_run: bool = False) -> dict[str, DataFrame]:
    """End of a run that wrote something: duplicates of one identity onto their canonical row; no notice is sent."""
    named = store["assignments"].join(store["profiles"].groupBy("user_id").agg(F.min(F.struct("first_name", "last_name")).alias("n")).select("user_id", "n.*"), "user_id", "left")
    plan = consolidate.consolidation_plan(consolidate.active(store["rows"]), named)
    return consolidate.apply_consolidation(plan, store["assignments"], store["rows"], now, dry_run=dry_run)


def _fixture(state: Column) -> Column:
    """What makes two states one fixture: teams and league, capitals and blanks aside."""
    part = lambda c: upper_tr(collapse(F.coalesce(state[c], F.lit(""))))
    return F.concat_ws("|", part("match_name"), part("league_type"))


def plan_notices(assigned: DataFrame, cancelled: DataFrame, shifted: DataFrame, waiting: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Events of a run, and cancellations that still wait, as notices; begun fixtures tell nobody anything.

    assigned, cancelled, waiting: (user_id, event_id, content_key, state); shifted: (user_id, event_id, content_key, old,
    state), assignments kept on a fixture whose crew changed. A shifted assignment uses up its user's new assignments of the
    same fixture and is UPDATED where something is to be told; cancellations, also waiting ones of users with new
    assignments, are paired with those left; a pair of one fixture without a difference is told to nobody.
    planned: (kind, user_id, content_key, old_content_key, event_id, state, old, lines), one notice a kind, user and fixture;
    consumed: (event_id) of waiting cancellations that were paired.
    """
    ahead = lambda df: df.where(~started(F.col("state.date_text"), F.col("state.time_text"), now))
    # lines are long expressions: each is computed into a durable frame before anything asks for it twice
    kept = durable(ahead(shifted).withColumn("lines", notices.change_lines(F.col("old"), F.col("state"))))
    new = durable(ahead(assigned).join(kept.select("user_id", "content_key").distinct(), ["user_id", "content_key"], "left_anti"))
    met = waiting.join(new.select("user_id").distinct(), "user_id", "left_semi")
    gone = durable(ahead(cancelled).withColumn("queued", F.lit(False)).unionByName(ahead(met).withColumn("queued", F.lit(True))))
    event = lambda df, side: df.select(
        "user_id", F.lit(side).alias("side"), "event_id", "content_key", _fixture(F.col("state")).alias("fixture"), parse_day(F.col("state.date_text")).cast("string").alias("day"), "queued",
    )
    pairs = durable(notices.pair_events(event(new.withColumn("queued", F.lit(False)), "assign").unionByName(event(gone, "cancel"))))
    here = new.select("user_id", "event_id", "content_key", "state")
    before = gone.select("user_id", F.col("event_id").alias("other_id"), F.col("queued").alias("other_queued"), F.col("content_key").alias("old_content_key"), F.col("state").alias("old"))
    blank = [F.lit(None).cast(before.schema[c].dataType).alias(c) for c in ("old_content_key", "old")]
    met_new = pairs.where("kind <> 'CANCELLED'").join(here, ["user_id", "event_id"]).join(before, ["user_id", "other_id", "other_queued"], "left")
    alone = pairs.where("kind = 'CANCELLED'").select("user_id", "kind", "event_id").join(gone.where("NOT queued").select("user_id", "event_id", "content_key", "state"), ["user_id", "event_id"])
    lines = F.when(F.col("kind") == "UPDATED", notices.change_lines(F.col("old"), F.col("state"))).otherwise(F.array().cast("array<string>"))
    cols = ["kind", "user_id", "content_key", "old_content_key", "event_id", "state", "old"]
    told = durable(met_new.select(*cols).unionByName(alone.select(*cols[:3], blank[0], *cols[4:6], blank[1])).withColumn("lines", lines))
    told = told.where((F.col("kind") != "UPDATED") | (F.size("lines") > 0)).withColumn("_order", F.lit(1))
    stayed = kept.where(F.size("lines") > 0).select(F.lit("UPDATED").alias("kind"), "user_id", "content_key", blank[0], "event_id", "state", "old", "lines", F.lit(0).alias("_order"))
    flat = stayed.unionByName(told).withColumns({"match_name": F.col("state.match_name"), "date_text": F.col("state.date_text"), "_at": F.struct("_order", "event_id")})
    planned = notices.first_of_each(flat, "_at").select(*cols, "lines")
    return {"planned": planned, "consumed": pairs.where("other_queued").select(F.col("other_id").alias("event_id"))}


def reconcile(events: dict[str, DataFrame], queue: DataFrame, now: datetime, bootstrap: bool = False) -> dict[str, DataFrame]:
    """A run's events into the queue: plan, drop what was paired, queue what waits, hand over what is sent at once.

    events: assigned, cancelled, shifted as in plan_notices; queue: (id, user_id, kind, content_key, old_content_key,
    state, old, status, due_at, attempt, drop_reason). The first run of all tells nobody anything. Returns the queue and
    ``immediate``, the notices of new assignments.
    """
    none = queue.limit(0).select("kind", "user_id", "content_key", "old_content_key", "state", "old")
    if bootstrap:
        return {"queue": queue, "immediate": none}
    pending = queue.where("status = 'PENDING' AND kind = 'CANCELLED'").select("user_id", F.col("id").alias("event_id"), "content_key", "state")
    plan = plan_notices(events["assigned"], events["cancelled"], events["shifted"], pending, now)
    planned = durable(plan["planned"])
    dropped = plan["consumed"].select(F.col("event_id").alias("id"), F.lit("DROPPED").alias("status"), F.lit("assigned again in the same run").alias("drop_reason"))
    left = durable(outbox.mark(queue, dropped))
    fresh = planned.where("kind <> 'ASSIGNED'").select("user_id", "kind", "content_key", "old_content_key", "state", "old")
    out = left.unionByName(merge.with_ids(outbox.enqueue(left, fresh, now).where("id IS NULL").drop("id"), left, "id", ["user_id", "kind", "content_key"]), allowMissingColumns=True)
    return {"queue": out.select(*queue.columns), "immediate": planned.where("kind = 'ASSIGNED'").select(*none.columns)}


def flush(queue: DataFrame, assignments: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """(id, user_id, action, reason, send_as, content_key, state, lines, attempt) of the notices that are due, confirmed against the current state in set-based joins.

    What an UPDATED notice tells is made anew from the state it was queued with and the row the user is on now, crews included, so
    edits taken back meanwhile are not told and a notice without a difference left is dropped. A CHANGED notice whose
    new fixture is lost tells the cancellation of the old one.
    """
    due = outbox.due(queue, now)
    current = outbox.current_rows(assignments, rows)
    fields = queue.schema["state"].dataType.names
    here = current.select("user_id", "content_key", F.struct(*(F.col(f"row.{c}").alias(c) for c in fields)).alias("_row"))
    before = current.select("user_id", F.col("content_key").alias("old_content_key"), F.lit(True).alias("_old"))
    q = due.join(here, ["user_id", "content_key"], "left").join(before, ["user_id", "old_content_key"], "left")
    q = durable(q.withColumn("_lines", notices.change_lines(F.col("old"), F.col("_row"))))
    state, lines = F.coalesce("_row", "state"), F.col("_lines")
    begun = started(state["date_text"], state["time_text"], now)
    done = outbox.confirm(F.col("kind"), F.col("_row").isNotNull(), F.col("_old"), begun, started(F.col("old.date_text"), F.col("old.time_text"), now), F.size(lines) > 0, F.col("old").isNotNull())
    judged = durable(q.withColumn("c", done))
    back = (F.col("kind") == "CHANGED") & (F.col("c.send_as") == "CANCELLED")
    told = F.when(F.col("c.send_as") == "UPDATED", lines).otherwise(F.array().cast("array<string>"))
    return judged.select(
        "id", "user_id", "c.*", F.when(back, F.col("old_content_key")).otherwise(F.col("content_key")).alias("content_key"),
        F.when(back, F.col("old")).otherwise(state).alias("state"), told.alias("lines"), "attempt",
    )


def settle(queue: DataFrame, flushed: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """The queue after a flush: dropped with reason, SENT before anything is sent, and what failed for a while put back with its next try.

    flushed: flush's rows; results: (id, user_id, success, code) of the tokens each sent notice went to, nothing for users without tokens.
    """
    at = F.lit(now).cast("timestamp_ntz")
    per = outbox.delivery_class(results.select(F.col("id").alias("user_id"), "success", "code")).select(F.col("user_id").alias("id"), "outcome")
    tried = F.coalesce("attempt", F.lit(0)) + 1
    judged = flushed.join(per, "id", "left").withColumn("r", outbox.next_retry(tried, at))
    again = (F.col("action") == "send") & (F.col("outcome") == "transient")
    status = F.when(F.col("action") == "drop", "DROPPED").when(again, F.col("r.status")).otherwise("SENT")
    why = F.when(F.col("action") == "drop", F.col("reason")).when(status == "FAILED", F.concat(F.lit("not delivered in "), tried.cast("string"), F.lit(" tries")))
    changed = judged.select("id", status.alias("status"), F.when(again & (status == "PENDING"), F.col("r.due_at")).otherwise(at).alias("due_at"), F.when(F.col("action") == "send", tried).otherwise(F.col("attempt")).alias("attempt"), why.alias("drop_reason"))
    return outbox.mark(queue, changed)
