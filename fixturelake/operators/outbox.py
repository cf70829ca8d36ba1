"""The queue in which notices wait, are confirmed against the current state, delivered and tried again."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes a notice waits before it is confirmed; waits after each failed try; notices taken per run.
CONFIRM_MINUTES, RETRY_MINUTES, FLUSH = 10, [1, 2, 5, 15, 30], 500
TRANSIENT = ["messaging/internal-error", "messaging/server-unavailable", "messaging/unknown-error", "messaging/message-rate-exceeded", "messaging/device-message-rate-exceeded", "messaging/quota-exceeded", "app/network-error", "app/network-timeout"]


def enqueue(queue: DataFrame, planned: DataFrame, now: datetime, minutes: int = CONFIRM_MINUTES) -> DataFrame:
    """The queue with new notices added; one already pending for the same user, kind and fixture stays alone.

    planned: (user_id, kind, content_key, ...). ASSIGNED notices are sent at once and never queued here.
    """
    key = lambda c: F.coalesce(c, F.lit(""))
    pending = queue.where("status = 'PENDING'").select("user_id", "kind", key(F.col("content_key")).alias("_k")).distinct()
    new = planned.where("kind <> 'ASSIGNED'").withColumn("_k", key(F.col("content_key"))).join(pending, ["user_id", "kind", "_k"], "left_anti").drop("_k")
    due = F.lit(now + timedelta(minutes=max(1, minutes))).cast("timestamp_ntz")
    return queue.unionByName(new.withColumns({"status": F.lit("PENDING"), "due_at": due, "attempt": F.lit(0)}), allowMissingColumns=True)


def due(queue: DataFrame, now: datetime, most: int = FLUSH) -> DataFrame:
    """The first pending notices by id that are due: a top-k, not a sort of the queue."""
    return queue.where((F.col("status") == "PENDING") & (F.col("due_at") <= F.lit(now).cast("timestamp_ntz"))).orderBy("id").limit(most)


def current_rows(assignments: DataFrame, rows: DataFrame) -> DataFrame:
    """(user_id, content_key, row struct): for each user and identity the active row with the greatest id."""
    live = rows.where("cancelled_at IS NULL AND content_key IS NOT NULL")
    on = assignments.where("user_id IS NOT NULL").select("user_id", F.col("match_id").alias("id")).join(live, "id")
    return on.groupBy("user_id", "content_key").agg(F.max_by(F.struct(*live.columns), "id").alias("row"))


def confirm(kind: Column, on_match: Column, on_old: Column, begun: Column, begun_old: Column, has_changes: Column, old_known: Column) -> Column:
    """struct(action, reason, send_as) of a waiting notice, from the state at hand.

    begun: whether the fixture the notice is about has started (the current one where the user is on it).
    """
    drop = lambda why: F.struct(F.lit("drop").alias("action"), F.lit(why).alias("reason"), F.lit(None).cast("string").alias("send_as"))
    send = lambda k: F.struct(F.lit("send").alias("action"), F.lit(None).cast("string").alias("reason"), k.alias("send_as"))
    on, old = F.coalesce(on_match, F.lit(False)), F.coalesce(on_old, F.lit(False))
    return (
        F.when(kind == "ASSIGNED", F.when(~on, drop("not on the fixture")).when(begun, drop("begun")).otherwise(send(kind)))
        .when(kind == "CANCELLED", F.when(on, drop("back on the fixture")).when(begun, drop("begun")).otherwise(send(kind)))
        .when(kind == "UPDATED", F.when(~on, drop("not on the fixture")).when(begun, drop("begun")).when(~has_changes, drop("nothing left to tell")).otherwise(send(kind)))
        .when(on, F.when(begun, drop("begun")).when(old, drop("still on the old fixture")).otherwise(send(kind)))
        .when(~old & F.coalesce(old_known, F.lit(False)) & ~F.coalesce(begun_old, F.lit(True)), send(F.lit("CANCELLED")))
        .otherwise(drop("not on the new fixture"))
    )


def next_retry(attempt: Column, now: Column) -> Column:
    """struct(status, due_at) after a failed try number ``attempt`` (from 1): waits grow, then FAILED."""
    wait = F.get(F.array(*map(F.lit, RETRY_MINUTES)), attempt - 1)
    return F.struct(F.when(wait.isNull(), "FAILED").otherwise("PENDING").alias("status"), (now + F.make_dt_interval(mins=wait)).alias("due_at"))


def mark(queue: DataFrame, changed: DataFrame) -> DataFrame:
    """The queue with status, due_at, attempt and drop_reason taken over from ``changed`` (by id)."""
    cols = [c for c in ("status", "due_at", "attempt", "drop_reason") if c in changed.columns and c in queue.columns]
    new = changed.select("id", *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_hit"))
    out = queue.join(new, "id", "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).select(*queue.columns)


def delivery_class(results: DataFrame) -> DataFrame:
    """(user_id, outcome, n_tokens, error_codes) of token results (user_id, success, code).

    One success delivers; else one transient or missing code makes the failure transient. Codes are joined in order.
    """
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    code = F.coalesce("code", F.lit("unknown"))
    agg = results.groupBy("user_id").agg(
        F.bool_or(~failed).alias("_ok"), F.bool_or(failed & (F.col("code").isNull() | F.col("code").isin(*TRANSIENT))).alias("_t"),
        F.count(F.lit(1)).alias("n_tokens"), F.sort_array(F.collect_set(F.when(failed, code))).alias("_codes"),
    )
    outcome = F.when(F.col("_ok"), "delivered").when(F.col("_t"), "transient").otherwise("permanent")
    return agg.select("user_id", outcome.alias("outcome"), "n_tokens", F.nullif(F.substring(F.array_join("_codes", ","), 1, 500), F.lit("")).alias("error_codes"))


def delivery_rows(wanted: DataFrame, results: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, status, n_tokens, error_codes) for every wanted user: without tokens, denied, delivered or failed."""
    denied = users.where("push_permission = 'denied'").select(F.col("id").alias("user_id"), F.lit(True).alias("_denied"))
    all_ = wanted.select("user_id").distinct().join(delivery_class(results), "user_id", "left").join(denied, "user_id", "left")
    status = (
        F.when(F.col("outcome").isNull(), "NO_TOKEN").when(F.col("outcome") == "delivered", F.when(F.col("_denied"), "PERMISSION_DENIED").otherwise("DELIVERED"))
        .when(F.col("outcome") == "transient", "TRANSIENT_FAIL").otherwise("PERMANENT_FAIL")
    )
    return all_.select("user_id", status.alias("status"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "error_codes")


def group_cancels(notices: DataFrame) -> DataFrame:
    """(fixture, user_ids, n): cancellations of one fixture told together; users in order."""
    key = F.coalesce("content_key", F.concat_ws("|", "match_name", "date_text"))
    return notices.where("kind = 'CANCELLED'").groupBy(key.alias("fixture")).agg(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",").alias("user_ids"), F.countDistinct("user_id").alias("n"))


def counters(df: DataFrame, kind: str, values: list[str]) -> DataFrame:
    """One row of counts by kind."""
    return df.agg(*(F.count_if(F.col(kind) == v).alias(v.lower()) for v in values), F.count(F.lit(1)).alias("total"))
