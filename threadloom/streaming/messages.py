"""Structured Streaming over message files: the same keys and groups as in batch, with state bounded by a watermark.

Streams carry ts (timestamp) besides the message columns. State older than the delay is dropped; what arrives later than
that is late and left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

EPISODE = "thread_id long, start_ms long, end_ms long, hostile long, peak double"


def files(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder, per_trigger at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_arrivals(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Rows whose keys haven't been met within delay: importing a file again adds nothing."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, gap: str = "60 minutes", delay: str = "1 hour") -> DataFrame:
    """(thread_id, session_start, session_end, messages): sessions by the time from one message to the next, given out once the watermark has passed them."""
    w = F.session_window("ts", gap)
    out = stream.withWatermark("ts", delay).groupBy("thread_id", w.alias("w")).agg(F.count(F.lit(1)).alias("messages"))
    return out.select("thread_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "messages")


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(thread_id, day, sent, received) by UTC day, given out once the watermark has passed the day."""
    out = stream.withWatermark("ts", delay).groupBy("thread_id", F.window("ts", "1 day").alias("w")).agg(F.count_if(F.col("direction") == "outgoing").alias("sent"), F.count_if(F.col("direction") == "incoming").alias("received"))
    return out.select("thread_id", F.col("w.start").alias("day"), "sent", "received")


def episodes(stream: DataFrame, gap_ms: int, least: int, delay: str = "1 hour") -> DataFrame:
    """(EPISODE): clusters of hostile messages at most gap_ms apart, given out when the watermark is beyond their gap.

    A thread's state is its open clusters; messages may come in any order within the delay. Clusters under `least`
    messages are dropped as they close.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened: list[list[Any]] = [list(c) for c in zip(*state.get)] if state.exists else []
        for frame in frames:
            opened += [[int(ms), int(ms), 1, float(t)] for ms, t in zip(frame["ms"], frame["tension"])]
        merged: list[list[Any]] = []
        for c in sorted(opened):
            if merged and c[0] - merged[-1][1] <= gap_ms:
                last = merged[-1]
                last[1], last[2], last[3] = max(last[1], c[1]), last[2] + c[2], max(last[3], c[3])
            else:
                merged.append(c)
        now = state.getCurrentWatermarkMs()
        closed = [c for c in merged if c[1] + gap_ms < now]
        left = [c for c in merged if c[1] + gap_ms >= now]
        if left:
            state.update(tuple(list(v) for v in zip(*left)))
            state.setTimeoutTimestamp(max(now + 1, min(c[1] for c in left) + gap_ms + 1))
        elif state.exists:
            state.remove()
        rows = [(key[0], *c) for c in closed if c[2] >= least]
        yield pd.DataFrame(rows, columns=["thread_id", "start_ms", "end_ms", "hostile", "peak"])

    kept = "start_ms array<long>, end_ms array<long>, hostile array<long>, peak array<double>"
    hot = stream.filter("tension >= 2 and not is_reaction").withWatermark("ts", delay).select("thread_id", "ms", "ts", F.col("tension").cast("double").alias("tension"))
    return hot.groupBy("thread_id").applyInPandasWithState(step, EPISODE, kept, "append", GroupStateTimeout.EventTimeTimeout)


def drain(out: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there to Parquet files and stop; running it again with the same checkpoint goes on from there."""
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def merge_daily(stream: DataFrame, path: str, checkpoint: str, late_ms: int = 86_400_000) -> None:
    """Add all that is there to the daily totals of the store at path (table totals: thread_id, day, sent, received), and stop.

    Each batch is one version of the store together with its number, so that a batch that is run again after a kill
    changes nothing. Messages over late_ms older than the newest of the batches before count too, and are kept in table
    late with the batch they came in. No state is held but the totals.
    """
    from threadloom.sources.versions import Store

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, path)
        progress = store.read("progress")
        last, newest = (-1, None) if progress is None else progress.first()
        if number <= last:
            return
        batch = batch.persist()
        day = F.floor(F.col("ms") / 86_400_000).alias("day")
        counts = batch.groupBy("thread_id", day).agg(F.count_if(F.col("direction") == "outgoing").alias("sent"), F.count_if(F.col("direction") == "incoming").alias("received"))
        before = store.read("totals")
        totals = counts if before is None else before.unionByName(counts).groupBy("thread_id", "day").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
        now = batch.agg(F.lit(number).cast("long").alias("batch"), F.greatest(F.max("ms"), F.lit(newest).cast("long")).alias("newest_ms"))
        late = batch.filter(F.col("ms") < F.lit(newest).cast("long") - late_ms).select("thread_id", "id", "ms", F.lit(number).cast("long").alias("batch"))
        store.commit(replace={"totals": totals, "progress": now}, append={"late": late})
        batch.unpersist()

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
