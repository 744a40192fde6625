"""The event log as streams. Events are snapshots, so repeats and disorder are harmless; each stream has a batch twin in ``operators``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from speechlake.operators.operations import COALESCE_MS, PROGRESS_STEP, STALE_SECONDS, run_progress


def coalesced(events: DataFrame, kinds: Sequence[str], late: str = "10 minutes", window_ms: int = COALESCE_MS) -> tuple[DataFrame, DataFrame]:
    """The named kinds, the latest of each window when it closes; and all other kinds as they come."""
    held = events.where(F.col("kind").isin(*kinds)).withWatermark("created_at", late)
    held = held.groupBy("run_id", "kind", F.window("created_at", f"{window_ms} milliseconds")).agg(F.max_by(F.struct("seq", "data"), "seq").alias("x"))
    return held.select("run_id", "kind", "x.seq", "x.data"), events.where(~F.col("kind").isin(*kinds)).select("run_id", "kind", "seq", "data")


def latest(events: DataFrame) -> DataFrame:
    """The last write of each run and kind, to be written in update or complete mode."""
    return events.groupBy("run_id", "kind").agg(F.max("seq").alias("seq"), F.max_by("data", "seq").alias("data"))


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their sequence number inside the watermark."""
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["seq"])


def running_rates(scores: DataFrame, by: str = "lang") -> DataFrame:
    """The corpus rate of each language so far."""
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("total"))


def running_spend(usage: DataFrame, alert: float) -> DataFrame:
    return usage.groupBy("order_id").agg(F.sum("usd").alias("usd")).withColumn("alert", F.col("usd") >= alert)


def stale(events: DataFrame, late: str = "0 seconds", seconds: int = STALE_SECONDS) -> DataFrame:
    """run_id, last_ms, silent of runs whose last heartbeat is older than the limit, by event time: a timer for each run."""
    schema = "run_id long, last_ms long, silent boolean"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "last_ms": [last], "silent": [True]})
            return
        last = max([int(pdf["created_at"].max().value // 1_000_000) for pdf in frames] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    watched = events.withWatermark("created_at", late).select("run_id", "created_at")
    return watched.groupBy("run_id").applyInPandasWithState(update, schema, "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def progress_of(steps: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """run_id, progress of each run, for foreachBatch; with the last told values only changes of at least the least step."""
    now = run_progress(steps)
    if told is None:
        return now
    before = told.select("run_id", F.col("progress").alias("_b"))
    return now.join(before, "run_id", "left").where(F.col("_b").isNull() | (F.abs(F.col("progress") - F.col("_b")) >= PROGRESS_STEP)).drop("_b")


def cancelled_by(work: DataFrame, cancels: DataFrame, late: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """run_id, seq, kind, cancel of work that a cancel of its run precedes by no more than ``within``: a stream-stream join, told as soon as both are there."""
    w = work.withWatermark("created_at", late)
    c = cancels.select(F.col("run_id").alias("_run"), F.col("created_at").alias("_at"), F.col("seq").alias("cancel")).withWatermark("_at", late)
    met = (F.col("run_id") == F.col("_run")) & (F.col("_at") <= F.col("created_at")) & (F.col("_at") >= F.col("created_at") - F.expr(f"INTERVAL {within}"))
    return w.join(c, met).select("run_id", "seq", "kind", "cancel")


def drop_cancelled(work: DataFrame, cancels: DataFrame, late: str = "1 hour") -> DataFrame:
    """Work that no cancel of its run precedes: a stream-stream left join in which cancels come before their work."""
    w = work.withWatermark("created_at", late)
    c = cancels.select(F.col("run_id").alias("_run"), F.col("created_at").alias("_at")).withWatermark("_at", late)
    joined = w.join(c, (F.col("run_id") == F.col("_run")) & (F.col("_at") <= F.col("created_at")) & (F.col("_at") >= F.col("created_at") - F.expr("INTERVAL 1 HOUR")), "left")
    return joined.where("_run is null").drop("_run", "_at")


#: State store that operators with several state variables need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(stream: DataFrame, into: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is available now, and stop. Aggregates go through foreachBatch, a folder for each batch."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", into).start()
        else:
            query = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{into}/batch={n}")).start()
        query.awaitTermination()
    finally:
        conf.set(STORE[0], before) if before else conf.unset(STORE[0])
