"""Queries over the driver's tables, one or more for each operator family, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.functions import days, keys, text
from fixturelake.operators import consolidate, merge, notices, outbox, outcomes, resolve, sheets
from fixturelake.operators.instants import unusual, with_instant
from fixturelake.operators.snapshots import snapshot_changes
from fixturelake.plans import lifecycle
from fixturelake.plans.oracle import oracle_sql as _oracle_sql
from fixturelake.session import read_table
from fixturelake.sources import folders, sinks, values

#: "Now" of every query: always an explicit value, so results can be reproduced.
NOW = datetime(2025, 11, 1, 12, 0)
CUTOFF = date(2025, 8, 1)
TEXTS = ["match_name", "date_text", "time_text", "venue"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "match_rows")


def _active(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.active(_rows(spark, d))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """Assignments with the names of their users' profiles, referees first."""
    names = resolve_names(read_table(spark, d, "profiles"))
    return read_table(spark, d, "assignments").join(names, "user_id", "left")


def resolve_names(profiles: DataFrame) -> DataFrame:
    """(user_id, first_name, last_name): the referee profile where there is one, else the official one."""
    rank = F.struct((F.col("kind") == "REFEREE").alias("r"), F.col("first_name"), F.col("last_name"))
    return profiles.groupBy("user_id").agg(F.max_by(F.struct("first_name", "last_name"), rank).alias("n")).select("user_id", "n.*")


def _bare(a: DataFrame) -> DataFrame:
    return a.withColumns({"first_name": F.lit(None).cast("string"), "last_name": F.lit(None).cast("string")})


def _snapshot(spark: SparkSession, d: str, last: bool) -> DataFrame:
    """The first or the last delivery, one row a fixture (the one received and placed last)."""
    s = read_table(spark, d, "match_snapshots").where("content_key IS NOT NULL")
    at = s.agg((F.max if last else F.min)("snap_no").alias("snap_no"))
    one = s.join(F.broadcast(at), "snap_no")
    rank = F.struct("received_at", "src_row", F.coalesce("venue", F.lit("")).alias("v"), F.coalesce("time_text", F.lit("")).alias("t"))
    return one.groupBy("content_key").agg(F.max_by(F.struct(*[c for c in one.columns if c != "content_key"]), rank).alias("s")).select("content_key", "s.*")


def p4_changes(spark, d):
    return snapshot_changes(read_table(spark, d, "match_snapshots"), "snap_no", "content_key", ("received_at", "src_row"))


def p4_found(spark, d):
    return p4_changes(spark, d).select("snap_no", "content_key", "change_kind")


def p5_instants(spark, d):
    return with_instant(read_table(spark, d, "matches").select("rec_id", "date_text", "time_text"), "date_text", "time_text")


def p5_found(spark, d):
    return p5_instants(spark, d).where(unusual("date_text", "time_text") & F.col("start_utc").isNotNull()).select("rec_id", "start_utc")


def q01_content_key(spark, d):
    return _rows(spark, d).select("id", keys.content_key().alias("key"))


def q02_crew_key(spark, d):
    return _rows(spark, d).select("id", keys.match_key().alias("key"), keys.crew_size().alias("n"))


def q03_duplicate_groups(spark, d):
    return consolidate.duplicate_groups(_active(spark, d))


def q04_canonical_row(spark, d):
    return consolidate.canonical_rows(_active(spark, d))


def q05_canonical_in_pool(spark, d):
    return outcomes.canonical_in_pool(_rows(spark, d).withColumn("in_file", F.col("cancelled_at").isNull()))


def q06_carry_forward(spark, d):
    return sheets.parse_cells(_as_cells(read_table(spark, d, "matches"))).select("src_sheet", "src_row", "venue", "date_text")


def q07_group_ordinal(spark, d):
    return sheets.group_ordinal(read_table(spark, d, "matches"), ["src_row", "rec_id"]).select("rec_id", "src_row")


def q08_consolidation_plan(spark, d):
    return consolidate.consolidation_plan(_active(spark, d), _bare(read_table(spark, d, "assignments")))


def q08_consolidation_by_rule(spark, d):
    return consolidate.consolidation_plan(_active(spark, d), _assigned(spark, d))


def q08_consolidated(spark, d):
    rows, a = _rows(spark, d), _bare(read_table(spark, d, "assignments"))
    done = consolidate.apply_consolidation(consolidate.consolidation_plan(consolidate.active(rows), a), a, rows, NOW)
    return done["assignments"].select("id", "match_id")


def q09_snapshot_diff(spark, d):
    return outcomes.key_sides(*(_snapshot(spark, d, last) for last in (False, True)))


def q10_moved_semi(spark, d):
    last = _snapshot(spark, d, True)
    file = last.agg(F.min("src_file").alias("_file"))
    here = last.join(F.broadcast(file), F.col("src_file") == F.col("_file"), "left_semi")
    return outcomes.moved_keys(last.crossJoin(F.broadcast(file)), here, F.col("_file"))


def q11_change_detection(spark, d):
    f = read_table(spark, d, "files")
    known = f.where("last_md5 IS NOT NULL").select("file_id", "last_md5", F.date_trunc("DAY", F.col("modified").cast("timestamp")).cast("timestamp_ntz").alias("known_modified"))
    return merge.detect_changes(f.drop("last_md5"), known).select("file_id", "process")


def q12_upsert_reopen(spark, d):
    target = _rows(spark, d).select("id", "content_key", "venue", "time_text", "cancelled_at")
    source = _snapshot(spark, d, True).select("content_key", "venue", "time_text", "cancelled_at")
    return merge.upsert(target, source, ["content_key"], ["venue", "time_text", "cancelled_at"])


def q12_upsert_fixtures(spark, d):
    parsed = read_table(spark, d, "matches").drop("rec_id", "seen_at")
    return merge.upsert_fixtures(_rows(spark, d), parsed, NOW).select("match_key", "content_key", "cancelled_at")


def _decided(spark, d, a):
    last, first = _snapshot(spark, d, True), _snapshot(spark, d, False)
    here = last.where("cancelled_at IS NULL").select("content_key")
    moved = first.select("content_key").join(here, "content_key", "left_anti")
    files = last.select(F.col("content_key").alias("_k"), F.col("src_file").alias("_f"))
    rows = _active(spark, d)
    rows = rows.join(files, (rows.content_key == files["_k"]) & (rows.src_file == files["_f"]), "left").withColumn("in_file", F.col("_k").isNotNull()).drop("_k", "_f")
    return outcomes.decide(a, rows, here, moved, NOW)


def q13_outcome_decision(spark, d):
    return _decided(spark, d, _bare(read_table(spark, d, "assignments"))).select("id", "outcome", "to_match_id")


def q13_outcome_by_rule(spark, d):
    return _decided(spark, d, _assigned(spark, d)).select("id", "outcome", "to_match_id")


def q13_applied(spark, d):
    a = read_table(spark, d, "assignments")
    done = outcomes.apply_outcomes(_decided(spark, d, _bare(a)), a, _rows(spark, d), NOW)
    return done["rows"].groupBy("cancel_reason").agg(F.count(F.lit(1)).alias("n"))


def q14_safety_valve(spark, d):
    per = _rows(spark, d).groupBy("src_file").agg(F.count(F.when(F.col("cancelled_at").isNotNull(), 1)).alias("n"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("safe", outcomes.cancellation_safe(F.col("n"), F.col("total")))


def q15_missing_rows_valve(spark, d):
    here = _snapshot(spark, d, True).select("content_key")
    current = _rows(spark, d).join(here, "content_key", "left_semi").select("match_key")
    out = outcomes.cancel_missing(_rows(spark, d), current, read_table(spark, d, "assignments"), datetime(2015, 1, 1))
    return out.groupBy("src_file").agg(F.count(F.when(F.col("cancel_reason") == "not in file", 1)).alias("n"))


def q16_not_started(spark, d):
    return read_table(spark, d, "matches").select("rec_id", days.started(F.col("date_text"), F.col("time_text"), NOW).alias("started"))


def q17_date_parse(spark, d):
    return read_table(spark, d, "matches").select("rec_id", days.parse_day(F.col("date_text")).alias("day"))


def q18_serial_dates(spark, d):
    m = read_table(spark, d, "matches")
    day = F.when(F.col("date_text").rlike(r"^\d{5}(\.\d+)?$"), F.col("date_text")).cast("double")
    part = F.when(F.col("time_text").rlike(r"^0\.\d+$"), F.col("time_text")).cast("double")
    return m.select("rec_id", day.alias("_d"), part.alias("_t")).where("_d IS NOT NULL OR _t IS NOT NULL").select("rec_id", days.serial_day(F.col("_d")).alias("day"), days.day_fraction(F.col("_t")).alias("clock"))


def q19_normalize_fold(spark, d):
    n = read_table(spark, d, "profiles").select("user_id", "kind", F.concat_ws(" ", "first_name", "last_name").alias("n"))
    return n.select("user_id", "kind", text.normalize_tr(F.col("n")).alias("normal"), text.fold_tr(F.col("n")).alias("folded"), text.squash(F.col("n")).alias("squashed"))


def q20_tokens(spark, d):
    cells = resolve.crew_cells(read_table(spark, d, "matches"), "rec_id")
    return cells.select(F.explode(text.words(F.col("cell"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _open_cells(spark, d):
    return read_table(spark, d, "assignments").where("user_id IS NULL").select(F.col("name_in_sheet").alias("cell"))


def q21_similarity_join(spark, d):
    return resolve.resolve_similar(_open_cells(spark, d), read_table(spark, d, "profiles")).select("cell", "user_id", F.round("similarity", 6).alias("similarity"))


def q22_typo_pairs(spark, d):
    w = read_table(spark, d, "profiles").select(F.explode(F.split(text.fold_tr(F.col("last_name")), " ")).alias("w")).where("length(w) >= 5").distinct()
    keyed = w.withColumn("k", F.explode(resolve._delete_one(F.col("w"))))
    pairs = keyed.select(F.col("w").alias("a"), "k").join(keyed.select(F.col("w").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    return pairs.where(text.is_typo(F.col("a"), F.col("b"), 5))


def q23_name_rule(spark, d):
    return resolve.matched_pairs(_open_cells(spark, d), read_table(spark, d, "profiles"))


def q24_cell_resolution(spark, d):
    return resolve.resolve_cells(_open_cells(spark, d), read_table(spark, d, "profiles"))


def q24_build_assignments(spark, d):
    rows, a = _active(spark, d), read_table(spark, d, "assignments")
    people = resolve.active_profiles(read_table(spark, d, "profiles"), read_table(spark, d, "users"))
    had = a.where("user_id IS NOT NULL").join(_rows(spark, d).select(F.col("id").alias("match_id"), "content_key"), "match_id").select("user_id", "content_key", "created_at")
    return resolve.build_assignments(rows, people, had)


def q25_role_of_name(spark, d):
    a = read_table(spark, d, "assignments").select("id", "match_id", "name_in_sheet")
    rows = _rows(spark, d).select(F.col("id").alias("match_id"), *keys.CREWS)
    return a.join(rows, "match_id").select("id", keys.role_of(F.col("name_in_sheet")).alias("role"))


def q26_profile_union(spark, d):
    return resolve_names(read_table(spark, d, "profiles"))


def _with_key(spark, d):
    a = read_table(spark, d, "assignments").where("user_id IS NOT NULL")
    return a.join(_rows(spark, d).select(F.col("id").alias("match_id"), "content_key", "cancelled_at"), "match_id").where("content_key IS NOT NULL")


def q27_last_event_per_key(spark, d):
    return resolve.last_events(_with_key(spark, d))


def q28_inequality_anti(spark, d):
    sent = _with_key(spark, d).where("cancelled_at IS NOT NULL").select("user_id", "content_key", F.col("cancelled_at").alias("sent_at"))
    return resolve.not_cancelled_since(q27_last_event_per_key(spark, d), sent)


def q29_is_new_flag(spark, d):
    keyed, since = _with_key(spark, d), F.lit(datetime(2025, 10, 1)).cast("timestamp_ntz")
    return resolve.with_new_flag(keyed.where(F.col("created_at") >= since), resolve.last_events(keyed.where(F.col("created_at") < since))).select("id", "is_new")


def q30_multiset_diff(spark, d):
    a, b = (_snapshot(spark, d, last).select("content_key", F.coalesce("referees", keys.empty()).alias(n)) for last, n in ((False, "o"), (True, "n")))
    return a.join(b, "content_key").select("content_key", text.multiset_minus(F.col("o"), F.col("n")).alias("went"), text.multiset_minus(F.col("n"), F.col("o")).alias("came"))


def _states(spark, d):
    extra = [F.array().cast("array<string>").alias(c) for c in keys.CREWS[2:]]
    a, b = (_snapshot(spark, d, last).select("content_key", F.struct(*TEXTS, "category", F.lit(None).cast("string").alias("league_type"), F.lit(None).cast("string").alias("sub_category"), "referees", "table_officials", *extra).alias(n)) for last, n in ((False, "o"), (True, "n")))
    return a.join(b, "content_key").where(~F.col("o").eqNullSafe(F.col("n")))  # equal states have nothing to tell


def q31_change_lines(spark, d):
    lines = notices.change_lines(F.col("o"), F.col("n"))
    return _states(spark, d).select("content_key", lines.alias("lines")).where("size(lines) > 0")


def q31_messages(spark, d):
    lines = notices.change_lines(F.col("o"), F.col("n"))
    m = notices.message(F.lit("UPDATED"), F.col("n"), F.col("o"), lines)
    return _states(spark, d).where(F.size(lines) > 0).select("content_key", m.alias("m")).select("content_key", "m.title", "m.body", notices.push_message(F.col("m.title"), F.col("m.body"), F.lit("UPDATED")).alias("push"))


def _events(spark, d):
    rows = _rows(spark, d).select(F.col("id").alias("match_id"), "content_key", "cancelled_at", "match_name", "league_type", "date_text")
    a = read_table(spark, d, "assignments").where("user_id IS NOT NULL").join(rows, "match_id")
    fixture = F.concat_ws("|", text.upper_tr(text.collapse(F.col("match_name"))), text.upper_tr(text.collapse(F.coalesce("league_type", F.lit("")))))
    return a.select("user_id", F.when(F.col("cancelled_at").isNull(), "assign").otherwise("cancel").alias("side"), F.col("id").alias("event_id"), "content_key", fixture.alias("fixture"), days.parse_day(F.col("date_text")).cast("string").alias("day"), F.lit(False).alias("queued"))


def q32_greedy_plan(spark, d):
    return notices.pair_events(_events(spark, d))


def q33_confirm_queue(spark, d):
    a = read_table(spark, d, "assignments").where("user_id IS NOT NULL")
    rows = _rows(spark, d)
    queue = a.join(rows.select(F.col("id").alias("match_id"), "content_key", "cancelled_at", "date_text", "time_text"), "match_id")
    queue = queue.select("id", "user_id", "content_key", F.when(F.col("cancelled_at").isNull(), "ASSIGNED").otherwise("CANCELLED").alias("kind"), days.started(F.col("date_text"), F.col("time_text"), NOW).alias("begun"))
    now = outbox.current_rows(a, rows).select("user_id", "content_key", F.lit(True).alias("on"))
    no = F.lit(False)
    done = outbox.confirm(F.col("kind"), F.col("on"), no, F.col("begun"), no, no, no)
    return queue.join(now, ["user_id", "content_key"], "left").select("id", done.alias("c")).select("id", "c.action", "c.reason")


def _queue(spark, d):
    a = read_table(spark, d, "assignments")
    return a.select("id", "user_id", F.when(F.col("user_id").isNull(), "PENDING").otherwise("SENT").alias("status"), F.col("created_at").alias("due_at"))


def q34_due_topk(spark, d):
    return outbox.due(_queue(spark, d), NOW).select("id", "due_at")


def q35_retry_schedule(spark, d):
    tries = read_table(spark, d, "assignments").groupBy("match_id").agg(F.count(F.lit(1)).cast("int").alias("attempt"), F.max("created_at").alias("at"))
    return tries.select("match_id", "attempt", outbox.next_retry(F.col("attempt"), F.col("at")).alias("r")).select("match_id", "attempt", "r.status", "r.due_at")


def _tokens(spark, d):
    e = read_table(spark, d, "events")
    code = F.when(F.col("event_type") == "error", "messaging/quota-exceeded").when(F.col("event_type") == "view", "messaging/invalid-token").when(F.col("event_type") == "click", "messaging/not-registered")
    return e.select((F.col("user_id") + 1000).alias("user_id"), ((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("success"), code.alias("code"))


def q36_delivery_class(spark, d):
    return outbox.delivery_class(_tokens(spark, d))


def q36_delivery_rows(spark, d):
    u = read_table(spark, d, "users")
    return outbox.delivery_rows(u.select(F.col("id").alias("user_id")), _tokens(spark, d), u)


def q37_partition_diff(spark, d):
    """Identities without crews against identities with them."""
    rows = _rows(spark, d).withColumn("key", keys.match_key())
    split, merged = merge.partition_diff(rows, "content_key", "key")
    return split.select(F.col("content_key").alias("group_key"), F.lit("split").alias("kind"), "n").unionByName(merged.select(F.col("key").alias("group_key"), F.lit("merged").alias("kind"), "n"))


def q38_slot_duplicates(spark, d):
    return consolidate.slot_duplicates(_rows(spark, d))


def q38_slot_moves(spark, d):
    return consolidate.slot_moves(_rows(spark, d), _assigned(spark, d))


def q39_category_counts(spark, d):
    a = read_table(spark, d, "assignments").where("user_id IS NOT NULL").join(_rows(spark, d).select(F.col("id").alias("match_id"), "category"), "match_id")
    per = sheets.category_counts(a, ["user_id"])
    return per.select("user_id", F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))).alias("categories"))


def q40_cutoff_filter(spark, d):
    return read_table(spark, d, "matches").withColumn("day", days.parse_day(F.col("date_text"))).where(days.in_season(F.col("day"), CUTOFF)).select("rec_id", "day", days.season_key(F.col("day")).alias("season_key"))


def q41_fingerprint(spark, d):
    def prints(last, name):
        s = _snapshot(spark, d, last)
        per = s.groupBy("src_file").agg(F.sort_array(F.collect_list(F.struct("content_key", *TEXTS))).alias("rows"))
        return per.select("src_file", keys.tab_fingerprint("2025-2026", CUTOFF.isoformat(), F.col("src_file"), F.lit(""), F.col("rows")).alias(name))

    both = prints(False, "before").join(prints(True, "after"), "src_file", "full")
    return both.select("src_file", keys.may_skip(F.col("before"), F.col("after")).alias("skip"))


def q42_latest_partition(spark, d):
    f = read_table(spark, d, "files")
    top = folders.latest_season(f, "name").select("start")
    of = folders.seasons(f, "name").join(F.broadcast(top), "start")
    return f.join(of, "name").select("file_id", F.concat_ws("-", "start", "end").alias("season"))


def _as_cells(m: DataFrame) -> DataFrame:
    """Fixtures written as sheets: a header with a merged referee column, one row each, nulls as blank cells."""
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    seat = lambda c, k: F.coalesce(F.get(F.col(c), F.lit(k)), F.lit(""))
    row = F.array(*(text_of(c) for c in ("date_text", "time_text", "venue", "match_name", "category", "group_name")), seat("referees", 0), seat("referees", 1), seat("table_officials", 0), seat("observers", 0))
    body = m.select(F.col("src_file").alias("file"), F.col("src_sheet").alias("sheet"), (F.col("rec_id") + 1).cast("int").alias("row_no"), row.alias("cells"))
    names = ["TARİH", "SAAT", "SALON", "MAÇ", "KATEGORİ", "GRUP", "HAKEM", "", "SAYI GÖREVLİSİ", "GÖZLEMCİ"]
    head = m.select(F.col("src_file").alias("file"), F.col("src_sheet").alias("sheet")).distinct().select("file", "sheet", F.lit(1).alias("row_no"), F.array(*map(F.lit, names)).alias("cells"))
    return head.unionByName(body)


def q43_header_classify(spark, d):
    heads = sheets.header_rows(_as_cells(read_table(spark, d, "matches")))
    return heads.select("file", "sheet", "header_row", F.explode("fields").alias("field", "positions"))


def q43_parse_cells(spark, d):
    return sheets.parse_cells(_as_cells(read_table(spark, d, "matches"))).select("src_sheet", "src_row", "match_name", "date_text", "venue", "week", "league_type", "referees")


def q44_announcement_agg(spark, d):
    a = read_table(spark, d, "assignments").where("user_id IS NOT NULL")
    gone = _rows(spark, d).where("cancelled_at IS NOT NULL").select(F.col("id").alias("match_id"))
    return sinks.announcements(a.join(gone, "match_id"), NOW).select("match_id", F.col("targets").alias("user_ids"))


def q45_url_parse(spark, d):
    link = F.concat(F.lit("https://files.example/d/"), "file_id", F.lit("/edit?usp=x&resourcekey=k-"), "id")
    return read_table(spark, d, "files").select("id", text.drive_id(link).alias("file_id"), text.resource_key(link).alias("resource_key"))


def q46_wrongly_cancelled(spark, d):
    return consolidate.wrongly_cancelled(_rows(spark, d), read_table(spark, d, "assignments"))


def q47_shifted_groups(spark, d):
    return consolidate.shifted_groups(_rows(spark, d)).select("date_text", "time_text", "venue", "n_cancelled", "n_active", F.size("lost_names").alias("n_lost"))


def q48_reactivate(spark, d):
    out = consolidate.reactivate_nameless(_rows(spark, d), read_table(spark, d, "assignments"), NOW)
    return out.where(F.col("cancelled_at").isNull()).select("id")


def q49_active_profiles(spark, d):
    return resolve.active_profiles(read_table(spark, d, "profiles"), read_table(spark, d, "users")).select("user_id", "kind")


def q50_backfill_days(spark, d):
    filled, open_ = consolidate.backfill_days(_rows(spark, d).withColumn("match_date", F.when(F.col("week").isNotNull(), F.col("match_date"))))
    return filled.select("id", "match_date")


def q51_file_metadata(spark, d):
    n = F.col("name")
    return read_table(spark, d, "files").select("id", sheets.file_week(n).alias("week"), sheets.file_league(n).alias("league"), sheets.file_category(n).alias("category"), sheets.is_generic_sheet(n).alias("generic"))


def q52_formats(spark, d):
    return read_table(spark, d, "matches").select("rec_id", days.format_day(F.col("date_text")).alias("day"), days.format_time(F.col("time_text")).alias("clock"))


def q53_enqueue(spark, d):
    q = _with_key(spark, d).select("id", "user_id", F.when(F.col("cancelled_at").isNull(), "UPDATED").otherwise("CANCELLED").alias("kind"), "content_key")
    old = q.where("kind = 'CANCELLED'").withColumns({"status": F.lit("PENDING"), "due_at": F.lit(NOW).cast("timestamp_ntz"), "attempt": F.lit(0)})
    return outbox.enqueue(old, q, NOW).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def q54_group_cancels(spark, d):
    n = _with_key(spark, d).select("user_id", "content_key", F.lit("CANCELLED").alias("kind"), F.lit("").alias("match_name"), F.lit("").alias("date_text"), "cancelled_at")
    return outbox.group_cancels(n.where("cancelled_at IS NOT NULL"))


def q55_renamed_moves(spark, d):
    pairs = consolidate.wrongly_cancelled(_rows(spark, d), read_table(spark, d, "assignments"))
    listed = pairs.groupBy(F.col("from_row_id").alias("from_id")).agg(F.min("to_row_id").alias("to_id"))
    return consolidate.renamed_moves(read_table(spark, d, "assignments"), listed).select("id", "match_id")


def _run(spark, d):
    """Assignments on active, cancelled and changed fixtures as the events of one run."""
    state = F.struct(*TEXTS, "category", "league_type", "sub_category", *keys.CREWS)
    on = read_table(spark, d, "assignments").where("user_id IS NOT NULL").join(_rows(spark, d).select(F.col("id").alias("match_id"), "content_key", "cancelled_at", state.alias("state")), "match_id")
    on = on.select("user_id", F.col("id").alias("event_id"), "content_key", "state", "cancelled_at")
    changed = _states(spark, d).select("content_key", *(F.struct(*(F.col(f"{x}.{c}").alias(c) for c in (*TEXTS, "category", "league_type", "sub_category", *keys.CREWS))).alias(y) for x, y in (("o", "old"), ("n", "new"))))
    stays = on.where("cancelled_at IS NULL").join(changed, "content_key")
    return {"assigned": on.where("cancelled_at IS NULL").join(changed, "content_key", "left_anti").drop("cancelled_at"), "cancelled": on.where("cancelled_at IS NOT NULL").drop("cancelled_at"), "shifted": stays.select("user_id", "event_id", "content_key", "old", F.col("new").alias("state"))}


def q56_run_notices(spark, d):
    run = _run(spark, d)
    plan = lifecycle.plan_notices(run["assigned"], run["cancelled"], run["shifted"], run["cancelled"].limit(0), datetime(2015, 1, 1))
    return plan["planned"].select("kind", "user_id", "content_key", "event_id", "lines")


def q57_tab_values(spark, d):
    """Days as serial numbers and times as parts of a day, as a tab of raw values holds them, read back as texts."""
    m = read_table(spark, d, "match_rows").where("match_date IS NOT NULL")
    number = lambda c: F.struct(F.lit(None).cast("string").alias("text"), c.cast("double").alias("number"))
    word = lambda c: F.struct(c.cast("string").alias("text"), F.lit(None).cast("double").alias("number"))
    body = m.select(F.lit("t").alias("title"), F.concat(F.lit("tab"), F.floor(F.col("id") / 4000)).alias("tab"), (F.col("id") % 4000 + 2).cast("int").alias("row_no"), F.array(number(F.datediff("match_date", F.lit(date(1899, 12, 30)))), number((F.col("id") % 96) / 96), word(F.col("match_name"))).alias("values"))
    head = body.select("title", "tab").distinct().select("title", "tab", F.lit(1).alias("row_no"), F.array(*(word(F.lit(x)) for x in ("TARİH", "SAAT", "MAÇ"))).alias("values"))
    return values.tab_cells(head.unionByName(body)).where("row_no > 1").select("sheet", "row_no", F.col("cells")[0].alias("day"), F.col("cells")[1].alias("clock"), F.col("cells")[2].alias("name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[:1] in "pq" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return _oracle_sql()
