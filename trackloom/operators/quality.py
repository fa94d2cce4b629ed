"""Quality of composite events, and the documents of those that are good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scoring as S

ACCEPT, LEAST_DURATION, LEAST_FRAMES = 0.50, 0.10, 4


def score(events: DataFrame, include_review: bool = True, least_duration: float = LEAST_DURATION, least_frames: int = LEAST_FRAMES, most: float | None = 1.0) -> DataFrame:
    """raw_score, reasons and hard_reject of each event, by its type; unknown types are
    rejected with score 0. Scores end at `most`; None: they are the sums of their points."""
    track, pair = F.col("event_type") == "track_semantic_event", F.col("event_type") == "relationship_event"
    d = F.coalesce("duration_seconds", F.lit(0.0))
    status = F.coalesce("reliability_status", F.lit("unknown"))
    reliable, review = status == "reliable", (status == "review") & F.lit(include_review)
    long, mid, short, least = d >= 1.0, (d >= 0.5) & (d < 1.0), (d >= 0.2) & (d < 0.5), (d >= least_duration) & (d < 0.2)
    colour = F.size(F.coalesce("colour_attributes", F.create_map().cast("map<string,string>"))) > 0
    moves = (F.coalesce("motion_state", F.lit("unknown")) != "unknown") | (F.coalesce("motion_direction", F.lit("unknown")) != "unknown")
    place = F.col("start_region").isNotNull() & F.col("end_region").isNotNull()
    one = [
        (reliable, 0.40, "reliable_track"), (~reliable & review, 0.22, "review_track"), (~reliable & ~review, 0.0, "weak_reliability"),
        (long, 0.25, "long_duration"), (mid, 0.20, "medium_duration"), (short, 0.12, "short_valid_duration"), (least, 0.06, "minimum_valid_duration"), (d < F.least(F.lit(0.2), F.lit(least_duration)), 0.0, "too_short"),
        (colour, 0.15, "colour_attributes"), (moves, 0.10, "motion_attributes"), (place, 0.10, "spatial_attributes"),
    ]
    n, near, over = F.coalesce("shared_frames", F.lit(0)), F.coalesce("near_ratio", F.lit(0.0)), F.coalesce("overlap_ratio", F.lit(0.0))
    kinds = F.coalesce("relationship_types", F.array().cast("array<string>"))
    two = [
        (n >= 15, 0.40, "strong_temporal_support"), ((n >= 8) & (n < 15), 0.32, "good_temporal_support"), ((n >= 5) & (n < 8), 0.24, "moderate_temporal_support"),
        ((n >= least_frames) & (n < 5), 0.16, "minimum_temporal_support"), (n < F.least(F.lit(5), F.lit(least_frames)), 0.0, "insufficient_temporal_support"),
        (near >= 0.80, 0.25, "strong_near_evidence"), ((near >= 0.50) & (near < 0.80), 0.15, "moderate_near_evidence"),
        (over >= 0.50, 0.20, "strong_overlap_evidence"), ((over >= 0.30) & (over < 0.50), 0.12, "moderate_overlap_evidence"),
        (F.array_contains(kinds, "moving_together"), 0.15, "moving_together"), (F.array_contains(kinds, "human_near_vehicle"), 0.15, "human_vehicle_interaction"), (F.size(kinds) > 0, 0.10, "semantic_relationship"),
    ]
    points = lambda rows: S.points(*[(t, v) for t, v, _ in rows])
    total = lambda rows: points(rows) if most is None else F.least(F.lit(most), points(rows))
    why = lambda rows: S.reasons(*[(t, name) for t, _, name in rows])
    return events.withColumns(
        {
            "raw_score": F.when(track, total(one)).when(pair, total(two)).otherwise(0.0),
            "quality_reasons": F.when(track, why(one)).when(pair, why(two)).otherwise(F.array(F.lit("unknown_event_type"))),
            "hard_reject": F.when(track, d < least_duration).when(pair, n < least_frames).otherwise(True),
        }
    )


def judge(scored: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Accepted or rejected, by the score before it is rounded."""
    ok = ~F.col("hard_reject") & (F.round("raw_score", 9) >= accept)
    return scored.withColumns(
        {
            "accepted": ok,
            "quality_score": F.round("raw_score", 4),
            "quality_label": S.quality_label(F.round("raw_score", 9)),
            "rejection_reason": F.when(~ok, F.when(F.col("hard_reject"), "hard_reject").otherwise("below_quality_threshold")),
        }
    ).drop("raw_score")


def document_text(description: Column, start: Column, end: Column) -> Column:
    d = F.trim(F.coalesce(description, F.lit("")))
    d = F.when(d.endswith("."), d).otherwise(F.concat(d, F.lit(".")))
    timed = F.when(start.isNotNull() & end.isNotNull(), F.format_string(" The event occurred from %.2f seconds to %.2f seconds.", start, end)).otherwise("")
    return F.when(F.trim(F.coalesce(description, F.lit(""))) != "", F.concat(d, timed))


def documents(judged: DataFrame) -> DataFrame:
    """Texts and metadata of accepted events; none of an event without a description."""
    text = document_text(F.col("description"), F.col("start_time_seconds"), F.col("end_time_seconds"))
    said = F.trim(F.coalesce("description", F.lit(""))) != ""  # there is a text then, and only then
    return judged.where("accepted").where(said).withColumn("text", text).select(
        F.col("event_id").alias("document_id"), "text", *(["video_id"] if "video_id" in judged.columns else []), "event_id", "event_type", "quality_score", "quality_label", "track_ids", "class_names", "start_time_seconds", "end_time_seconds",
        "reliability_status", "colour_attributes", "motion_state", "motion_direction", "region_transition", "relationship_types", "shared_frames", "near_ratio", "overlap_ratio",
    )


def summary(judged: DataFrame) -> DataFrame:
    """Events and accepted ones by type, with a grand total; rows stand for n events."""
    n, good = F.sum("n"), F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0))
    return judged.rollup("event_type").agg(n.alias("events"), good.alias("accepted"), F.round(good / n, 4).alias("acceptance_rate"))


def reason_counts(judged: DataFrame) -> DataFrame:
    """Events by reason; rows stand for n events."""
    return judged.select(F.explode("quality_reasons").alias("reason"), "n").groupBy("reason").agg(F.sum("n").alias("events"))
