"""Streams: windowed counts, deduplication within a watermark, cache replay, ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def timed(events: DataFrame) -> DataFrame:
    """Events with a time a watermark accepts; files may hold times without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of each window, for a table or a stream."""
    e = timed(events)
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = timed(events)
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, finish, n): runs of a user's events with no longer gap."""
    e = timed(events)
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def unique(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of an event that arrive within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def cache_replay(accesses: DataFrame, ttl_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(key, hits, misses, ts) of a stream of accesses (key, ts): an access hits if the entry made
    by the last miss is no older than the time to live. A key's state goes once the watermark
    has passed its entry's time; timeouts follow event time, as those of processing time would
    keep a run over what is available from ever ending."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        created, hits, misses = state.get if state.exists else (None, 0, 0)
        last = None
        times = sorted(t for f in batches for t in f["ts"])
        for t in times:
            at = t.timestamp()
            if created is not None and at - created <= ttl_seconds:
                hits += 1
            else:
                created, misses = at, misses + 1
            last = t
        if state.hasTimedOut:
            state.remove()
        elif created is not None:
            state.update((created, hits, misses))
            state.setTimeoutTimestamp(max(int((created + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        if last is not None:
            yield pd.DataFrame([(key[0], hits, misses, last)], columns=["key", "hits", "misses", "ts"])

    return accesses.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, "key string, hits bigint, misses bigint, ts timestamp", "created double, hits bigint, misses bigint", "update", GroupStateTimeout.EventTimeTimeout)


def file_stream(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, prepare=None):
    """Replace, batch by batch, the documents that arrive: each batch overwrites just their
    partitions of the table at ``target``, so an interrupted batch can be run again. Returns
    the started query."""

    def write(batch: DataFrame, _: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.partitionBy("document").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
