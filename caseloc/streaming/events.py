"""Structured Streaming jobs over an append-only event log (ts, user_id,
event_type, value, ...). Each takes a streaming or a static DataFrame, so the
same code gives the batch answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.session import shared_path

DELAY = "1 hour"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet files at ``path``, a file or a folder of files."""
    static = spark.read.parquet(path)
    first = static.inputFiles()[0]
    folder, name = first.rsplit("/", 1)
    single = path.rstrip("/").endswith(name)
    return spark.readStream.schema(static.schema).option("pathGlobFilter", name if single else "*.parquet").parquet(folder)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available and return what came out: all batches in
    append mode, the last one in complete mode. Batches and the checkpoint are in
    the shared folder, so a restart goes on where it stopped."""
    spark = stream.sparkSession
    out, state = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id:06d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{out}/batch=*")
    if mode == "complete":
        rows = rows.where(F.col("_batch") == (rows.agg(F.max("_batch")).first()[0] or 0))
    return rows.drop("_batch")


def current_state(events: DataFrame) -> DataFrame:
    """The latest event of each user; among equal times the largest id."""
    latest = F.max_by(F.struct("event_type", "value", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(F.max("ts").alias("last_update"), latest.alias("x")).select("user_id", "last_update", "x.event_type", "x.value")


def throughput(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and summed value by window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", DELAY).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def phase_durations(events: DataFrame, start: str, end: str, within: str = "2 hours") -> DataFrame:
    """(user_id, start_id, end_id, seconds): each start with the ends that follow
    it within a time bound: a stream-stream join whose state the bound limits."""
    begun = events.where(F.col("event_type") == start).select(F.col("user_id").alias("u"), F.col("event_id").alias("start_id"), F.col("ts").alias("t0"))
    ended = events.where(F.col("event_type") == end).select("user_id", F.col("event_id").alias("end_id"), F.col("ts").alias("t1"))
    pairs = begun.withWatermark("t0", DELAY).join(
        ended.withWatermark("t1", DELAY), F.expr(f"u = user_id AND t1 >= t0 AND t1 <= t0 + INTERVAL {within}")
    )
    return pairs.select("user_id", "start_id", "end_id", ((F.unix_micros("t1") - F.unix_micros("t0")) / 1e6).alias("seconds"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events without a gap: start, end and number."""
    out = events.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str], within: str = "3650 days") -> DataFrame:
    """Distinct keys: repeats within the watermark's delay are dropped."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys).select(*keys)
    return events.select(*keys).distinct()


def stalls(events: DataFrame, seconds: float = 7_200.0) -> DataFrame:
    """(user_id, stalled_from, gap_seconds): silences of over ``seconds`` between
    two events of a user. The state of a user is its last event time."""

    def step(key: tuple, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        times = sorted(t for frame in frames for t in (frame["ts"].astype("int64") // 1_000).tolist())
        out = []
        for t in times:
            if last is not None and t - last > seconds * 1_000_000:
                out.append((key[0], pd.Timestamp(last, unit="us"), (t - last) / 1e6))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "stalled_from", "gap_seconds"])

    slim = events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return slim.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, stalled_from timestamp_ntz, gap_seconds double", "last long", "append", GroupStateTimeout.NoTimeout
    )


def unfinished(issues: DataFrame, done: DataFrame) -> DataFrame:
    """Streamed issues that no finished row names: a stream-static anti join;
    with a kept checkpoint each issue is handled once across restarts."""
    return issues.join(done.select("user_id").distinct(), "user_id", "left_anti")


def late_events(events: DataFrame, delay_seconds: int = 3_600) -> DataFrame:
    """(event_id, late_seconds): events that come after a later one by more than
    the delay, in order of event_id, which is the order of arrival."""
    from pyspark.sql.window import Window

    day = F.floor(F.col("event_id") / 4_096)
    tops = events.groupBy(day.alias("part")).agg(F.max("ts").alias("top"))
    # Running tops: within blocks of 4,096 parts, then over the blocks (one for each 16 million events).
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocked = tops.withColumn("block", F.floor(F.col("part") / 4_096))
    inside = blocked.withColumn("near", F.max("top").over(earlier(Window.partitionBy("block").orderBy("part"))))
    blocks = blocked.groupBy("block").agg(F.max("top").alias("block_top"))
    far = blocks.select("block", F.max("block_top").over(earlier(Window.orderBy("block"))).alias("far"))
    so_far = inside.join(far, "block").select("part", F.greatest("near", "far").alias("prior"))
    within = Window.partitionBy("part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("part", day).join(so_far, "part").withColumn("seen", F.greatest("prior", F.max("ts").over(within)))
    behind = F.unix_micros("seen") - F.unix_micros("ts")
    return rows.where(behind > delay_seconds * 1_000_000).select("event_id", (behind / 1e6).alias("late_seconds"))
