"""Streams of observations: sessions of tracks, sampled frames, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.tracks import KEY, keyed
from trackloom.plans import staging
from trackloom.sources import sinks


def track_sessions(observations: DataFrame, gap: str = "30 seconds", lateness: str = "1 minute") -> DataFrame:
    """Tracks closed by a gap in their observations: bounds and count of each session.
    observations: ts, track_id, class_name, frame_index, confidence."""
    return (
        keyed(observations).withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("session"), *KEY)
        .agg(F.count("*").alias("observation_count"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
        .select(*KEY, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "observation_count", "first_frame", "last_frame", "mean_confidence")
    )


SAMPLED = "video_id string, frame_index long, timestamp_seconds double, motion_score double, motion_level string, sampling_fps double"


def sample_stream(frames: DataFrame) -> DataFrame:
    """The adaptive sampler over a stream: the time of the last emitted frame is the state of
    each video. Frames of a trigger are taken in their order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame_index")
        kept = []
        for f, t, m in zip(rows.frame_index, rows.timestamp_seconds, rows.motion_score, strict=True):
            level, fps = ("low", 1.0) if m < 2 else ("medium", 2.0) if m < 12 else ("high", 5.0)
            if last is None or t - last >= 1 / fps - 1e-9:
                last = float(t)
                kept.append((key[0], f, t, m, level, fps))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["video_id", "frame_index", "timestamp_seconds", "motion_score", "motion_level", "sampling_fps"])

    return frames.groupBy("video_id").applyInPandasWithState(run, SAMPLED, "last double", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(path: str, key: str, order: str | None = None):
    """A foreachBatch writer that keeps one row for each key. Each epoch is a version of the
    table, path/<epoch>, made of the last one; versions before the last are removed. Only a table
    that has no version yet is taken to be empty: a version that can't be read is an error, and
    an epoch that is written again replaces its own version."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < epoch]
        target = spark.read.schema(batch.schema).parquet(f"{path}/{before[-1]}") if before else batch.limit(0)
        sinks.upsert(target, batch, key, order).write.mode("overwrite").parquet(f"{path}/{epoch}")
        for v in before[:-1]:
            staging.delete(spark, f"{path}/{v}")

    return write


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that have been written as a whole, ascending."""
    return sorted(int(n) for n in staging.children(spark, path) if n.isdigit() and staging.exists(spark, f"{path}/{n}/_SUCCESS"))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last whole version."""
    return spark.read.parquet(f"{path}/{versions(spark, path)[-1]}")
