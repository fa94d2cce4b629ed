"""Adaptive sampling of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level(score: Column) -> Column:
    return F.when(score < 2, "low").when(score < 12, "medium").otherwise("high")


def rate(score: Column) -> Column:
    return F.when(score < 2, 1.0).when(score < 12, 2.0).otherwise(5.0)


def scored(frames: DataFrame) -> DataFrame:
    """The level and the sampling rate of each frame."""
    return frames.withColumn("motion_level", level(F.col("motion_score"))).withColumn("sampling_fps", rate(F.col("motion_score")))


def motion_scores(frames: DataFrame, signature: str = "signature") -> DataFrame:
    """The mean absolute difference to the previous frame's signature; the first has 0."""
    before = F.lag(signature).over(Window.partitionBy("video_id").orderBy("frame_index"))
    diff = F.aggregate(F.zip_with(F.col(signature), before, lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x) / F.size(signature)
    return frames.withColumn("motion_score", F.coalesce(diff, F.lit(0.0)))


def sample(frames: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """frames (video_id, frame_index, timestamp_seconds, motion_score) -> those emitted.

    A frame is emitted if the interval of its own rate has gone by since the last emitted one,
    so each decision hangs on the last: the frames of a video stream by in order, and only the
    time of the last emitted one and the number of those before are held.
    """
    import numpy as np
    import pyarrow as pa

    rows = scored(frames).select("video_id", "frame_index", "timestamp_seconds", "motion_score", "motion_level", "sampling_fps")
    schema = "video_id string, sample_number int, frame_index long, timestamp_seconds double, motion_score double, motion_level string, sampling_fps double"

    def run(batches):
        video, last, number = None, None, 0
        for b in batches:
            keep, numbers = [], []
            for i, (v, t, rate) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if v != video or not number:
                    video, last, number = v, None, 0
                if last is None or (t is not None and t - last >= 1 / rate - tolerance):
                    last, number = t, number + 1
                    keep.append(i)
                    numbers.append(number)
            mine = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([mine.column(0), pa.array(np.asarray(numbers), pa.int32()), *mine.columns[1:]], ["video_id", "sample_number", *b.schema.names[1:]])

    types = {"video_id": "string", "frame_index": "long", "timestamp_seconds": "double", "motion_score": "double", "sampling_fps": "double"}
    rows = rows.withColumns({c: F.col(c).cast(k) for c, k in types.items()})
    out = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_index").mapInArrow(run, schema)
    return out.withColumn("image_name", F.format_string("frame_%06d_src_%06d.jpg", "sample_number", "frame_index"))
