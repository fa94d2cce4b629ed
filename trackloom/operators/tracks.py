"""Features of tracks: bounds, trajectories, motion, regions, representative crops, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import scoring as S


#: What a track is known by: its number is unique within its video only.
KEY = ["video_id", "track_id"]


def keyed(df: DataFrame) -> DataFrame:
    """Rows with a video_id; those of a single video without one get the empty string."""
    return df if "video_id" in df.columns else df.withColumn("video_id", F.lit(""))


def geometry(obs: DataFrame, width: int, height: int) -> DataFrame:
    """Centers, regions and clipped crops of single observations."""
    cx, cy = G.center(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    x1, y1, x2, y2 = G.crop(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), width, height)
    out = obs.withColumn("cx", cx).withColumn("cy", cy)
    out = out.withColumn("region", G.region(F.col("cx"), F.col("cy"), width, height))
    return out.withColumn("crop_width", x2 - x1).withColumn("crop_height", y2 - y1).withColumn("usable_crop", (F.col("crop_width") >= 40) & (F.col("crop_height") >= 40))


def temporal_bounds(obs: DataFrame, fps: float) -> DataFrame:
    """First and last frame and time of each track of each video; a missing time follows from
    the frame."""
    time = F.coalesce(F.col("timestamp_seconds"), F.col("frame_index") / fps)
    out = keyed(obs).groupBy(*KEY, "class_name").agg(
        F.min("track_pos").alias("track_pos"), F.count("*").alias("observation_count"),
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.min(time).alias("s"), F.max(time).alias("e"),
    )
    out = out.withColumn("duration", F.round(F.greatest(F.lit(0.0), F.col("e") - F.col("s")), 4))
    return out.withColumn("start_time", F.round("s", 4)).withColumn("end_time", F.round("e", 4)).drop("s", "e")


def trajectory(obs: DataFrame, fps: float) -> DataFrame:
    """Points in frame order with the segment that leads to each; rows without frame or box go.
    Times follow from frames."""
    cx, cy = G.center(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    points = keyed(obs).where("frame_index IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    points = points.select(*KEY, "class_name", "frame_index", "obs_pos", cx.alias("cx"), cy.alias("cy"), (F.col("frame_index") / fps).alias("time"))
    w = Window.partitionBy(*KEY).orderBy("frame_index", "obs_pos")
    points = points.withColumn("dx", F.col("cx") - F.lag("cx").over(w)).withColumn("dy", F.col("cy") - F.lag("cy").over(w))
    points = points.withColumn("gap", F.col("frame_index") - F.lag("frame_index").over(w)).withColumn("nth", F.row_number().over(w))
    return points.withColumn("step", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def motion(obs: DataFrame, width: int, height: int, fps: float) -> DataFrame:
    """Motion of each track. A track of one point has insufficient data. One exchange: the
    window and the aggregate share the partitioning by track."""
    diag = G.diagonal(width, height)
    on = F.col("gap") > 0
    unit = on & (F.col("step") > 1e-8)
    t = trajectory(obs, fps).groupBy(*KEY, "class_name").agg(
        F.count("*").alias("points"), F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"),
        F.min_by("cx", "nth").alias("sx"), F.min_by("cy", "nth").alias("sy"), F.max_by("cx", "nth").alias("ex"), F.max_by("cy", "nth").alias("ey"),
        F.sum(F.when(on, F.col("step"))).alias("path"), F.max(F.when(on, F.try_divide("step", F.col("gap") / fps))).alias("top_speed"),
        F.avg(F.when(unit, F.try_divide("dx", "step"))).alias("ux"), F.avg(F.when(unit, F.try_divide("dy", "step"))).alias("uy"),
    )
    t = t.withColumn("dx", F.col("ex") - F.col("sx")).withColumn("dy", F.col("ey") - F.col("sy")).withColumn("path", F.coalesce("path", F.lit(0.0)))
    t = t.withColumn("net", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).withColumn("duration", (F.col("end_frame") - F.col("start_frame")) / fps)
    state, way = G.motion_state(F.col("net") / diag, F.col("path") / diag), G.direction(F.col("dx"), F.col("dy"), diag)
    still = (state == "stationary") | (way == "stationary")
    few = F.col("points") < 2
    speed = F.coalesce(F.try_divide("path", "duration"), F.lit(0.0))
    hide = lambda c: F.when(~few, c)
    return t.select(
        *KEY, "class_name", F.col("points").alias("trajectory_points"),
        F.when(few, "insufficient_data").when(still, "stationary").otherwise(state).alias("motion_state"),
        F.when(few, "unknown").when(still, "stationary").otherwise(way).alias("direction"),
        hide(F.col("start_frame")).alias("start_frame"), hide(F.col("end_frame")).alias("end_frame"), hide(F.round("duration", 4)).alias("duration"),
        hide(F.round("sx", 2)).alias("start_x"), hide(F.round("sy", 2)).alias("start_y"), hide(F.round("ex", 2)).alias("end_x"), hide(F.round("ey", 2)).alias("end_y"),
        hide(F.round("dx", 2)).alias("horizontal_displacement"), hide(F.round("dy", 2)).alias("vertical_displacement"), hide(F.round("net", 2)).alias("net_displacement_pixels"),
        hide(F.round("path", 2)).alias("path_distance_pixels"), hide(F.round(F.col("net") / diag, 6)).alias("normalized_displacement"), hide(F.round(F.col("path") / diag, 6)).alias("normalized_path_distance"),
        hide(F.round(speed, 2)).alias("average_speed_pixels_per_second"), hide(F.round(F.coalesce("top_speed", F.lit(0.0)), 2)).alias("maximum_speed_pixels_per_second"), hide(F.round(speed / diag, 6)).alias("normalized_average_speed"),
        hide(F.round(F.when(F.col("points") >= 3, S.clamp(F.coalesce(F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")), F.lit(0.0)))).otherwise(0.0), 4)).alias("motion_consistency"),
    )


def spatial(moved: DataFrame, width: int, height: int) -> DataFrame:
    """Start and end region of each track that has a trajectory, with transitions in words."""
    m = keyed(moved).where("trajectory_points >= 2")
    m = m.withColumn("start_region", G.region(F.col("start_x"), F.col("start_y"), width, height)).withColumn("end_region", G.region(F.col("end_x"), F.col("end_y"), width, height))
    a, b = F.col("start_region"), F.col("end_region")
    return m.select(
        *KEY, "class_name", "motion_state", "direction", "start_region", "end_region",
        G.transition(a["combined"], b["combined"]).alias("region_transition"), G.transition(a["horizontal"], b["horizontal"], "remained_").alias("horizontal_transition"),
        G.transition(a["vertical"], b["vertical"], "remained_").alias("vertical_transition"),
        G.spatial_sentence(F.col("class_name"), F.col("motion_state"), a["combined"], b["combined"]).alias("description"),
    )


def region_counts(placed: DataFrame) -> DataFrame:
    """Tracks by start region, by end region and by transition, in one pass (grouping sets)."""
    rows = placed.select(F.col("start_region.combined").alias("s"), F.col("end_region.combined").alias("e"), F.col("region_transition").alias("t"))
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("start", "s"), ("end", "e"), ("transition", "t"))])).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("tracks"))


def best_crops(obs: DataFrame, width: int, height: int, sharpness: str | None = None, keep: int = 3) -> DataFrame:
    """The best-scored crops of each track (40 by 40 pixels at least), ties in order."""
    g = geometry(keyed(obs), width, height).where("usable_crop")
    sharp = S.sharpness_score(F.col(sharpness)) if sharpness else F.lit(0.0)
    g = g.withColumn("size_score", S.size_score(F.col("crop_width") * F.col("crop_height"), width * height)).withColumn("center_score", S.center_score(F.col("cx"), F.col("cy"), width, height)).withColumn("sharpness_score", sharp)
    g = g.withColumn("final_score", S.crop_score(F.col("confidence"), F.col("sharpness_score"), F.col("size_score"), F.col("center_score")))
    w = Window.partitionBy(*KEY).orderBy(F.col("final_score").desc(), "obs_pos")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def reliability(bounds: DataFrame, crops: DataFrame) -> DataFrame:
    """Score, status and reasons of each track that has a crop. Thresholds apply to the score
    before it is rounded."""
    per = keyed(crops).groupBy(*KEY).agg(
        F.count("*").alias("crop_count"), F.avg(F.coalesce("final_score", F.lit(0.5))).alias("mean_score"), (F.max(F.coalesce("final_score", F.lit(0.5))) - F.min(F.coalesce("final_score", F.lit(0.5)))).alias("spread"),
        F.avg(F.coalesce("confidence", F.lit(0.5))).alias("mean_confidence"),
    )
    t = keyed(bounds).join(per, KEY)
    n, k = F.col("observation_count"), F.col("crop_count")
    lost, named = S.penalty(F.col("class_name"), n, k)
    t = t.withColumn("persistence_score", S.persistence(n, F.col("class_name")))
    t = t.withColumn("crop_consistency_score", S.clamp(0.70 * F.col("mean_score") + 0.30 * F.when(k == 1, 0.55).otherwise(S.clamp(1 - F.col("spread")))))
    t = t.withColumn("confidence_score", S.clamp(F.col("mean_confidence"))).withColumn("crop_count_score", S.clamp(k / 3)).withColumn("penalty", lost)
    t = t.withColumn("raw", S.clamp(0.35 * F.col("persistence_score") + 0.30 * F.col("crop_consistency_score") + 0.20 * F.col("confidence_score") + 0.15 * F.col("crop_count_score") - F.col("penalty")))
    why = S.reasons(*named, (F.col("persistence_score") < 0.30, "weak_temporal_persistence"), (F.col("crop_consistency_score") < 0.35, "weak_crop_quality"), (F.col("confidence_score") < 0.35, "low_detection_confidence"))
    return t.select(
        *KEY, "class_name", "track_pos", "observation_count", "crop_count", S.reliability_status(F.col("raw")).alias("status"), F.round("raw", 4).alias("score"),
        *[F.round(c, 4).alias(c) for c in ("persistence_score", "crop_consistency_score", "confidence_score", "crop_count_score", "penalty")],
        F.when(F.size(why) == 0, F.array(F.lit("no_major_quality_issue"))).otherwise(why).alias("reasons"),
    )


def crop_counts(crops: DataFrame) -> DataFrame:
    """Tracks by their number of representative crops, with the mean score of these."""
    per = keyed(crops).groupBy(*KEY).agg(F.count("*").alias("crop_count"), F.avg("final_score").alias("mean"))
    return per.groupBy("crop_count").agg(F.count("*").alias("tracks"), F.round(F.avg("mean"), 6).alias("mean_score"))


def class_counts(detections: DataFrame) -> DataFrame:
    """Detections of each class of each video: frames, boxes, total, mean and best confidence."""
    return keyed(detections).groupBy("video_id", "class_name").agg(
        F.count_distinct("frame_index").alias("frames"), F.count("*").alias("detections"),
        F.round(F.sum("confidence"), 4).alias("total_confidence"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("best_confidence"),
    )


def status_counts(rated: DataFrame) -> DataFrame:
    """Tracks by class and status, zeros filled in."""
    return rated.groupBy("class_name").pivot("status", ["reliable", "review", "reject"]).count().na.fill(0)


def usable(rows: DataFrame, rated: DataFrame, include_review: bool = True) -> DataFrame:
    """Rows of usable tracks; a track without a rating is rejected."""
    good = keyed(rated).where(F.col("status").isin(["reliable", "review"] if include_review else ["reliable"]))
    return keyed(rows).join(good.select(*KEY, F.col("status").alias("reliability_status"), F.col("score").alias("reliability_score")), KEY)


def verify_crops(detections: DataFrame) -> DataFrame:
    """Each crop by its best detection of an allowed class (a pedestrian may be seen as
    people and the other way round), with a confidence of 0.20 or more."""
    alike = F.when(F.col("class_name").isin("pedestrian", "people"), F.array(F.lit("pedestrian"), F.lit("people"))).otherwise(F.array("class_name"))
    hit = F.array_contains(alike, F.col("detected_class"))
    out = keyed(detections).groupBy(*KEY, "crop_id").agg(F.max(F.when(hit, F.col("confidence"))).alias("match_confidence"), F.count("detected_class").alias("detected"))
    ok = F.coalesce(F.col("match_confidence") >= 0.20, F.lit(False))
    return out.withColumn("verified", ok).withColumn("reason", F.when(ok, "class_match").when(F.col("detected") == 0, "no_detection").when(F.col("match_confidence").isNull(), "class_mismatch").otherwise("low_confidence"))


def verification_counts(verified: DataFrame) -> DataFrame:
    """Tracks by status before and after their crops were verified."""
    return verified.groupBy("status", "final_status").agg(F.count("*").alias("tracks"))


def verify_tracks(crops: DataFrame, rated: DataFrame) -> DataFrame:
    """Visual and combined score and status of each rated track."""
    v = keyed(crops).groupBy(*KEY).agg(F.count("*").alias("crops"), F.count_if("verified").alias("verified"), F.avg(F.when(F.col("verified"), F.col("match_confidence"))).alias("mean_match"))
    t = keyed(rated).select(*KEY, "status", "score").join(v, KEY, "left").na.fill({"crops": 0, "verified": 0})
    visual = 0.65 * F.coalesce(F.try_divide("verified", "crops"), F.lit(0.0)) + 0.35 * F.coalesce("mean_match", F.lit(0.0))
    t = t.withColumn("visual_score", visual).withColumn("final", 0.55 * F.col("score") + 0.45 * F.col("visual_score"))
    s, f = F.col("visual_score"), F.col("final")
    verdict = F.when((F.col("status") == "reject") | (F.col("verified") == 0), "reject").when((F.col("status") == "reliable") & (s >= 0.55) & (f >= 0.60), "reliable").when((s >= 0.30) & (f >= 0.40), "review").otherwise("reject")
    return t.withColumn("final_status", verdict).withColumn("visual_score", F.round("visual_score", 4)).withColumn("final_score", F.round("final", 4)).drop("final")
