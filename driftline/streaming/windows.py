"""Windowed and deduplicating forms that run on tables and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_rates(changes: DataFrame, at: str = "at", length: str = "1 hour", every: str = "5 minutes", late: str | None = None) -> DataFrame:
    """(site_id, start, n): changes per sliding window."""
    rows = changes.withWatermark(at, late) if late else changes
    return rows.groupBy("site_id", F.window(at, length, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("site_id", F.col("w.start").alias("start"), "n")


def outage_sessions(log: DataFrame, at: str = "at", gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """(site_id, start, end, n): failures with gaps under `gap` as one session, which ends `gap` after its last."""
    bad = log.where((F.col("status") <= 0) | (F.col("status") >= 500))
    bad = bad.withWatermark(at, late) if late else bad
    return bad.groupBy("site_id", F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("site_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup_observations(log: DataFrame, keys: list[str], at: str = "at", late: str = "1 hour") -> DataFrame:
    """One row per observation: on a stream within the watermark, on a table over all of it."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if log.isStreaming else log.dropDuplicates(keys)


def split_by_time(log: DataFrame, now: Column, oldest: Column, at: str = "at") -> dict[str, DataFrame]:
    """The rows in time, those that are late and those from the future, to be written to tables of their own."""
    return {"in_time": log.where(F.col(at).between(oldest, now)), "late": log.where(F.col(at) < oldest), "future": log.where(F.col(at) > now)}


def notify_sink(path: str, deliver: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: events are saved under their batch number before they are delivered, so that a batch that comes again
    writes the same place; event_id tells deliveries apart."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["event_id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if deliver:
            deliver(batch.sparkSession.read.parquet(f"{path}/batch={number}"))

    return write


def divide_late(path: str, event_time: str, late_ms: int):
    """For foreachBatch, before what keeps state: a batch's rows that are `late_ms` or more behind the latest row of all batches before it go
    to path/late, all others to path/in_time, each in a folder of their batch, so that a batch may be written again. Every row comes
    to one of both. event_time is a column of milliseconds; a row without one is late."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..sources.shared import new_table

        spark, own = batch.sparkSession, new_table(batch, "batch")
        mark = own.agg(F.max(event_time).alias("at"))
        mark.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        # a row per batch
        last = spark.read.schema("at long, batch long").parquet(f"{path}/marks").where(F.col("batch") < batch_id).agg(F.max("at")).first()[0]
        late = F.col(event_time).isNull() | (F.lit(False) if last is None else F.col(event_time) <= last - late_ms)
        own.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        own.where(~late).write.mode("overwrite").parquet(f"{path}/in_time/batch={batch_id}")

    return write
