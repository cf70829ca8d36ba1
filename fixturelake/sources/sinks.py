"""Where results go: snapshots swapped whole, append-only logs, undo logs, pluggable senders."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, version: str, partition: str | None = None) -> str:
    """Write a new version beside the old one and name it; readers switch by name, so a failed run changes nothing."""
    to = f"{path}/version={version}"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(to)
    return to


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).transform(lambda d: d.where(F.col("version") == d.agg(F.max("version")).first()[0])).drop("version")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def undo_log(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def observed(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The frame with its rows counted as it is written, without another pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o


def sync_log(spark: SparkSession, folder: str, started: datetime, ended: datetime, rows: int, errors: list[str]) -> DataFrame:
    return spark.createDataFrame([(folder, started, ended, rows, errors)], "folder string, started timestamp_ntz, ended timestamp_ntz, rows long, errors array<string>")


def announcements(cancelled: DataFrame, now: datetime) -> DataFrame:
    """(match_id, targets, created_at): one row a cancelled fixture with its users in order."""
    users = F.array_join(F.transform(F.sort_array(F.collect_set("user_id")), lambda x: x.cast("string")), ",")
    return cancelled.groupBy("match_id").agg(users.alias("targets")).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))


def send(messages: DataFrame, sender: Callable[[list[dict]], list[dict]], chunk: int = 500) -> DataFrame:
    """(user_id, success, code) of messages given to a sender chunk by chunk, where they lie.

    A sender that fails marks its chunk as failed without a code, which counts as transient; tasks may be
    repeated, so a sender must treat (id, attempt) as the name of a message.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at : at + chunk].to_dict("records")
                try:
                    out += [(r["user_id"], bool(r["success"]), r.get("code")) for r in sender(part)]
                except Exception:  # noqa: BLE001
                    out += [(r["user_id"], False, None) for r in part]
            yield pd.DataFrame(out, columns=["user_id", "success", "code"])

    return messages.mapInPandas(run, "user_id long, success boolean, code string")
