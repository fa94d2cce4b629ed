"""Relationships of tracks that share frames of a video."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import vocabulary as V
from trackloom.operators.tracks import KEY, keyed
from trackloom.plans import staging

#: Shares of the shared frames that near and overlapping pairs need; frames and mean distance
#: of those that move together.
NEAR, OVER, TOGETHER_FRAMES, TOGETHER = 0.50, 0.30, 5, 0.06
KINDS = ("near", "overlapping", "human_near_vehicle", "moving_together")


def framed(obs: DataFrame) -> DataFrame:
    """Observations with their centers and the number of their frame in the order in which the
    frames of a video came in."""
    o = keyed(obs).where("frame_index IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    came = Window.partitionBy("video_id").orderBy("first", "frame_index")
    frames = o.groupBy("video_id", "frame_index").agg(F.min(F.struct("track_pos", "obs_pos")).alias("first"))
    frames = frames.select("video_id", "frame_index", F.row_number().over(came).alias("frame_rank"))
    cx, cy = G.center(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return o.join(frames, ["video_id", "frame_index"]).withColumn("cx", cx).withColumn("cy", cy)


def _box(side: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2"))


def _side(o: DataFrame, side: str, shared: list[str], *more: str) -> DataFrame:
    keep = ["track_id", "class_name", "track_pos", "obs_pos", "timestamp_seconds", "x1", "y1", "x2", "y2", "cx", "cy", *more]
    return o.select(*shared, *[F.col(c).alias(f"{side}_{c}") for c in keep])


def candidates(o: DataFrame, reach: float, near_frames: int, over_frames: int) -> DataFrame:
    """Two tracks of a video (track_a_id < track_b_id) that are within `reach` of one another, or
    overlap, in so many frames: what any relationship needs.

    A frame is cut into cells of the size of the reach. An observation stands in the cells of
    its box and of what lies within half the reach of its center, so two of them that are near
    or overlap share a cell; the pair is taken in the first cell they share. The join thus goes
    by (video, frame, cell), and its rows follow the number of neighbours.
    """
    low = lambda c, x: F.floor(F.least(F.col(x), F.col(c) - reach / 2) / reach)
    high = lambda c, x: F.floor(F.greatest(F.col(x), F.col(c) + reach / 2) / reach)
    o = o.withColumns({"left": low("cx", "x1"), "right": high("cx", "x2"), "top": low("cy", "y1"), "bottom": high("cy", "y2")})
    o = o.withColumn("across", F.explode(F.sequence("left", "right"))).withColumn("down", F.explode(F.sequence("top", "bottom")))
    shared = ["video_id", "frame_index", "across", "down"]
    p = _side(o, "a", shared, "left", "top").join(_side(o, "b", shared, "left", "top"), shared)
    p = p.where("a_track_id < b_track_id AND across = greatest(a_left, b_left) AND down = greatest(a_top, b_top)")
    near = G.distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy")) <= reach
    over = G.iou(_box("a"), _box("b")) > 0
    per = p.groupBy("video_id", F.col("a_track_id").alias("track_a_id"), F.col("b_track_id").alias("track_b_id")).agg(F.count_if(near).alias("n"), F.count_if(over).alias("o"))
    return per.where((F.col("n") >= near_frames) | (F.col("o") >= over_frames)).drop("n", "o")


def pair_rows(obs: DataFrame, width: int, height: int, near: float = 0.08, shared: int = 3) -> DataFrame:
    """One row for each frame that two tracks share, of tracks that come near or overlap in as
    many frames as a relationship needs at least. A track is never paired with itself."""
    diag = G.diagonal(width, height)
    o = staging.staged(framed(obs), "framed")  # four sides of joins read it
    # Pairs that move together are nearer than `near` in a share of their frames, as their mean is lower.
    least = [math.ceil(NEAR * shared), math.ceil(TOGETHER_FRAMES * (1 - TOGETHER / near)) if near > TOGETHER else 0]
    # Cells of a little more than the reach, so that rounding loses no pair at its end.
    found = candidates(o, near * diag * (1 + 1e-9), max(1, min(least)), max(1, math.ceil(OVER * shared)))
    a = _side(o, "a", ["video_id", "frame_index", "frame_rank"]).withColumn("track_a_id", F.col("a_track_id"))
    b = _side(o, "b", ["video_id", "frame_index"]).withColumn("track_b_id", F.col("b_track_id"))
    p = found.join(a, ["video_id", "track_a_id"]).join(b, ["video_id", "track_b_id", "frame_index"])
    first = (F.col("a_track_pos") < F.col("b_track_pos")) | ((F.col("a_track_pos") == F.col("b_track_pos")) & (F.col("a_obs_pos") < F.col("b_obs_pos")))
    return p.select(
        "video_id", "track_a_id", "track_b_id", F.col("a_class_name").alias("track_a_class"), F.col("b_class_name").alias("track_b_class"),
        "frame_index", "frame_rank", F.when(first, F.col("a_timestamp_seconds")).otherwise(F.col("b_timestamp_seconds")).alias("seconds"),
        (G.distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy")) / diag).alias("distance"), G.iou(_box("a"), _box("b")).alias("iou"),
    )


def statistics(pairs: DataFrame, near: float = 0.08, shared: int = 3, order: str = "insertion") -> DataFrame:
    """Pairs with enough shared frames. First and last follow the order in which frames came
    in ("insertion"), or time."""
    by = F.col("frame_rank") if order == "insertion" else F.col("frame_index")
    s = keyed(pairs).groupBy("video_id", "track_a_id", "track_b_id", "track_a_class", "track_b_class").agg(
        F.count("*").alias("shared_frames"), F.count_if(F.col("distance") <= near).alias("near_frames"), F.count_if(F.col("iou") > 0).alias("overlap_frames"),
        F.avg("distance").alias("average"), F.least(F.lit(1.0), F.min("distance")).alias("least"), F.max("iou").alias("iou"),
        F.min_by("frame_index", by).alias("first_frame"), F.max_by("frame_index", by).alias("last_frame"),
        F.min_by("seconds", by).alias("first_timestamp"), F.max_by("seconds", by).alias("last_timestamp"), F.min("frame_rank").alias("came"),
    )
    return s.where(F.col("shared_frames") >= shared)


def relationships(pairs: DataFrame, moved: DataFrame | None = None, together: float = TOGETHER, **options) -> DataFrame:
    """Named relationships of pairs; pairs without any are dropped. moved: motion of tracks,
    for those that move together (in one direction, close, five frames or more)."""
    s = statistics(pairs, **options)
    alike = F.lit(False)
    if moved is not None:
        ways = keyed(moved).select(*KEY, "direction")
        for side in ("a", "b"):
            one = ways.select("video_id", F.col("track_id").alias(f"track_{side}_id"), F.col("direction").alias(f"way_{side}"))
            s = s.join(one, ["video_id", f"track_{side}_id"], "left")
        alike = (F.col("way_a") == F.col("way_b")) & ~F.col("way_a").isin("unknown", "stationary")
    return named(s, alike, together)


def named(s: DataFrame, alike: Column, together: float = TOGETHER, *more: str) -> DataFrame:
    """The relationships that statistics of pairs amount to; pairs without any are dropped."""
    a, b = F.col("track_a_class"), F.col("track_b_class")
    mixed = (a.isin(V.HUMAN) & b.isin(V.VEHICLE_PAIRS)) | (b.isin(V.HUMAN) & a.isin(V.VEHICLE_PAIRS))
    near = F.col("near_frames") / F.col("shared_frames") >= NEAR
    over = F.col("overlap_frames") / F.col("shared_frames") >= OVER
    tests = (near, over, mixed & near, alike & (F.col("average") <= together) & (F.col("shared_frames") >= TOGETHER_FRAMES))
    kinds = F.array_compact(F.array(*[F.when(t, name) for t, name in zip(tests, KINDS, strict=True)]))
    return of_kinds(s.withColumn("relationship_types", kinds).where(F.size("relationship_types") > 0), *more)


def of_kinds(s: DataFrame, *more: str) -> DataFrame:
    """Relationships as products have them, of statistics with their kinds."""
    return s.select(
        "video_id", "track_a_id", "track_a_class", "track_b_id", "track_b_class", "relationship_types", "shared_frames", "near_frames", "overlap_frames",
        F.round(F.col("near_frames") / F.col("shared_frames"), 4).alias("near_ratio"), F.round(F.col("overlap_frames") / F.col("shared_frames"), 4).alias("overlap_ratio"), F.round("average", 6).alias("average_normalized_distance"),
        F.round("least", 6).alias("minimum_normalized_distance"), F.round("iou", 4).alias("maximum_iou"), "first_frame", "last_frame", "first_timestamp", "last_timestamp", "came", *more,
    )


def counts(related: DataFrame) -> DataFrame:
    """Pairs by relationship; rows stand for n pairs."""
    return related.select(F.explode("relationship_types").alias("relationship_type"), "n").groupBy("relationship_type").agg(F.sum("n").alias("pairs"))
