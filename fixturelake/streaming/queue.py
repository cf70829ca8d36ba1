"""The confirm queue as a stream: first notice kept, delayed, handed on when due; and file deliveries as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, kind string, content_key string, payload string, created_at timestamp, due_at timestamp"


def delayed(notices: DataFrame, minutes: int = 10) -> DataFrame:
    """Notices handed on once per (user, kind, fixture), ``minutes`` after the first of them.

    notices: a stream of (user_id, kind, content_key, payload, created_at). The first payload of a key is kept as
    the baseline; later ones until it is due fold into it, so several edits become one net difference. Event time
    decides, under a watermark of the same delay; a key is forgotten when it is handed on, so state stays bounded.
    """
    keyed = notices.withColumn("content_key", F.coalesce("content_key", F.lit(""))).withWatermark("created_at", f"{minutes} minutes")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            payload, created = state.get
            state.remove()
            at = pd.Timestamp(created, unit="ms")
            yield pd.DataFrame([(*key, payload, at, at + pd.Timedelta(minutes=minutes))], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        rows = pd.concat(list(batches))
        first = rows.sort_values("created_at", kind="stable").iloc[0]
        if not state.exists:
            created = int(first["created_at"].timestamp() * 1000)
            state.update((first["payload"], created))
        else:
            created = state.get[1]
        wait = created + minutes * 60_000
        state.setTimeoutTimestamp(max(wait, state.getCurrentWatermarkMs() + 1))

    grouped = keyed.groupBy("user_id", "kind", "content_key")
    return grouped.applyInPandasWithState(step, OUT, "payload string, created long", "append", GroupStateTimeout.EventTimeTimeout)


def deliveries(spark: SparkSession, path: str, schema: str, process: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """New delivery files handed to ``process`` batch by batch; files seen before are never listed again.

    ``process`` writes a snapshot named after the batch, so a repeated batch overwrites its own version.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def late_edits(snapshots: DataFrame, delay: str = "7 days") -> DataFrame:
    """Latest state per (fixture, day) of a stream of snapshot rows, edits up to ``delay`` late counted.

    snapshots: (content_key, received_at, ...). The aggregation keeps one row of state a fixture and day.
    """
    s = snapshots.withWatermark("received_at", delay)
    other = [c for c in snapshots.columns if c not in ("content_key", "received_at")]
    return s.groupBy("content_key", F.window("received_at", "1 day").alias("day")).agg(F.max_by(F.struct(*other), "received_at").alias("state"), F.count(F.lit(1)).alias("edits"))


