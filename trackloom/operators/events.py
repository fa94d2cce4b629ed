"""Atomic and composite events in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import vocabulary as V
from trackloom.operators.tracks import KEY, keyed
from trackloom.plans import staging


def positions(df: DataFrame, order: list, within: list[str] = (), name: str = "position", weight: str | None = None) -> DataFrame:
    """The rows with their place (from 1) in a total order, in all or within groups of any size;
    with a weight, the sum of it up to the row.

    The rows are dealt out by ranges and written once, with the number of their range; a place
    is that within the range plus what the ranges before it hold, so no task sees all rows.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = [F.col(f"`{c}`") for c in within]
    ranged = staging.staged(df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*groups, "_part").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part", *groups).orderBy(*order)
    nth = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(w)
    on = [F.col("r._part") == F.col("s._part")] + [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in within]
    out = ranged.withColumn("_nth", nth).alias("r").join((sizes if within else F.broadcast(sizes)).alias("s"), on)
    return out.select("r.*", "s._before").withColumn(name, F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")


def numbered(df: DataFrame, prefix: str, *order) -> DataFrame:
    """event_id in one sequence over the given total order, unique over all videos."""
    out = positions(df, list(order), name="event_number")
    return out.withColumn("event_id", F.format_string(prefix + "%06d", "event_number"))


def subject(class_name: Column, color: Column, upper: Column, lower: Column) -> Column:
    """Humans by their clothing, others by their colour."""
    known = lambda c: F.when(c != "unknown", c)
    parts = F.array_compact(F.array(F.concat(known(upper), F.lit(" upper clothing")), F.concat(known(lower), F.lit(" lower clothing"))))
    human = F.when(F.size(parts) > 0, F.concat(class_name, F.lit(" with "), F.array_join(parts, " and "))).otherwise(class_name)
    return F.when(class_name.isin(V.HUMAN), human).otherwise(F.concat(F.coalesce(F.concat(known(color), F.lit(" ")), F.lit("")), class_name))


def atomic(bounds: DataFrame, rated: DataFrame, colors: DataFrame | None = None, include_review: bool = True) -> DataFrame:
    """Three events of each usable track: observed over an interval, entered, exited. Numbers
    follow the order of videos and of their tracks."""
    good = keyed(rated).where(F.col("status").isin(["reliable", "review"] if include_review else ["reliable"]))
    good = good.select(*KEY, F.col("status").alias("reliability_status"), F.col("score").alias("reliability_score"))
    t = keyed(bounds).join(good, KEY)
    if colors is not None:
        t = t.join(keyed(colors).select(*KEY, "object_color", "upper_color", "lower_color"), KEY, "left")
    else:
        t = t.withColumns({c: F.lit(None).cast("string") for c in ("object_color", "upper_color", "lower_color")})
    who = subject(F.col("class_name"), F.col("object_color"), F.col("upper_color"), F.col("lower_color"))
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    names = ["k", "event_type", "start_time", "end_time", "duration", "timestamp", "frame_index", "event_text"]
    one = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    s, e, d = F.col("start_time"), F.col("end_time"), F.col("duration")
    kinds = F.array(
        one(F.lit(0), F.lit("object_observed"), s, e, d, none_d, none_l, F.format_string("%s observed from %.2fs to %.2fs for %.2fs", who, s, e, d)),
        one(F.lit(1), F.lit("object_entered"), none_d, none_d, none_d, s, F.col("first_frame"), F.format_string("%s entered the scene at %.2fs", who, s)),
        one(F.lit(2), F.lit("object_exited"), none_d, none_d, none_d, e, F.col("last_frame"), F.format_string("%s exited the scene at %.2fs", who, e)),
    )
    rows = t.select(*KEY, "track_pos", "class_name", "reliability_status", "reliability_score", "object_color", "upper_color", "lower_color", F.explode(kinds).alias("e")).select("*", "e.*").drop("e")
    return numbered(rows, "event_", "video_id", "track_pos", "track_id", "k").drop("k")


def ordered(events: DataFrame) -> DataFrame:
    """By time, then id: the order of the atomic product."""
    return events.orderBy(F.coalesce("start_time", "timestamp"), "event_id")


def color_attributes(color: Column, upper: Column, lower: Column) -> Column:
    """The known colours by name."""
    both = F.create_map(F.lit("object_color"), color, F.lit("upper_color"), upper, F.lit("lower_color"), lower)
    return F.map_filter(both, lambda _, v: v.isNotNull() & (v != "unknown") & (v != ""))


def object_phrase(class_name: Column, colors: Column) -> Column:
    c, u, w = (F.try_element_at(colors, F.lit(k)) for k in ("object_color", "upper_color", "lower_color"))
    wearing = F.concat(class_name, F.lit(" wearing "))
    return (
        F.when(c.isNotNull(), F.concat_ws(" ", c, class_name))
        .when(u.isNotNull() & w.isNotNull(), F.concat(wearing, u, F.lit(" upper clothing and "), w, F.lit(" lower clothing")))
        .when(u.isNotNull(), F.concat(wearing, u, F.lit(" upper clothing")))
        .when(w.isNotNull(), F.concat(wearing, w, F.lit(" lower clothing")))
        .otherwise(class_name)
    )


def track_sentence(phrase: Column, state: Column, way: Column, start: Column, end: Column) -> Column:
    a, b = G.readable(start), G.readable(end)
    return (
        F.when(state == "stationary", F.concat(phrase, F.lit(" remained stationary in the "), a, F.lit(" region")))
        .when((start != "unknown") & (end != "unknown") & (start != end), F.concat(phrase, F.lit(" moved from the "), a, F.lit(" region to the "), b, F.lit(" region")))
        .when(~way.isin("unknown", "stationary"), F.concat(phrase, F.lit(" moved "), G.readable(way), F.lit(" within the "), a, F.lit(" region")))
        .otherwise(F.concat(phrase, F.lit(" was observed in the "), a, F.lit(" region")))
    )


def pair_sentence(a: Column, b: Column, kinds: Column) -> Column:
    has = lambda k: F.array_contains(kinds, k)
    both = F.concat(F.lit("A "), a, F.lit(" and a "), b)
    return (
        F.when(has("moving_together"), F.concat(both, F.lit(" moved together")))
        .when(has("human_near_vehicle"), F.concat(F.lit("A person was near a "), F.when(b != "pedestrian", b).otherwise(a)))
        .when(has("overlapping"), F.concat(both, F.lit(" overlapped while visible together")))
        .when(has("near"), F.concat(both, F.lit(" remained near each other")))
        .otherwise(F.concat(both, F.lit(" were visible together")))
    )


#: The order of composite events: those of tracks, then those of pairs, video by video.
ORDER = ["video_id", "part", "o1", "o2", "o3"]


def composite(observed: DataFrame, moved: DataFrame, placed: DataFrame, related: DataFrame) -> DataFrame:
    """What each observed track did, then what each related pair did, in one numbering over
    the videos."""
    tracks = of_tracks(observed, moved, placed)
    return numbered(tracks.unionByName(of_pairs(related, tracks)), "composite_event_", *ORDER).drop(*ORDER[1:])


def of_tracks(observed: DataFrame, moved: DataFrame, placed: DataFrame) -> DataFrame:
    """What each observed track did, without a number."""
    m = keyed(moved).select(*KEY, "motion_state", F.col("direction").alias("motion_direction"))
    p = keyed(placed).select(*KEY, "start_region", "end_region", "region_transition")
    t = keyed(observed).where("event_type = 'object_observed'").join(m, KEY).join(p, KEY)
    t = t.withColumn("colour_attributes", color_attributes(F.col("object_color"), F.col("upper_color"), F.col("lower_color")))
    none = lambda kind: F.lit(None).cast(kind)
    return t.select(
        "video_id", F.lit(0).alias("part"), F.coalesce("start_time", F.lit(-1.0)).alias("o1"), F.col("event_number").cast("bigint").alias("o2"), F.lit(0).cast("bigint").alias("o3"),
        F.lit("track_semantic_event").alias("event_type"), F.array("track_id").alias("track_ids"), F.array("class_name").alias("class_names"),
        F.col("start_time").alias("start_time_seconds"), F.col("end_time").alias("end_time_seconds"), F.coalesce("duration", F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))).alias("duration_seconds"),
        "reliability_status", "colour_attributes", "motion_state", "motion_direction", "start_region", "end_region", "region_transition",
        none("array<string>").alias("relationship_types"), none("bigint").alias("shared_frames"), none("double").alias("near_ratio"), none("double").alias("overlap_ratio"),
        track_sentence(object_phrase(F.col("class_name"), F.col("colour_attributes")), F.col("motion_state"), F.col("motion_direction"), F.col("start_region.combined"), F.col("end_region.combined")).alias("description"),
    )


def of_pairs(related: DataFrame, tracks: DataFrame, *more: str) -> DataFrame:
    """What each related pair did, without a number, with the columns of events of tracks."""
    none = lambda kind: F.lit(None).cast(kind)
    lo, hi = F.least("first_timestamp", "last_timestamp"), F.greatest("first_timestamp", "last_timestamp")
    known = F.col("first_timestamp").isNotNull() & F.col("last_timestamp").isNotNull()
    place = tracks.schema["start_region"].dataType.simpleString()
    return keyed(related).select(
        "video_id", F.lit(1).alias("part"), F.lit(0.0).alias("o1"), F.col("track_a_id").alias("o2"), F.col("track_b_id").alias("o3"),
        F.lit("relationship_event").alias("event_type"), F.array("track_a_id", "track_b_id").alias("track_ids"), F.array("track_a_class", "track_b_class").alias("class_names"),
        F.when(known, lo).otherwise(F.col("first_timestamp")).alias("start_time_seconds"), F.when(known, hi).otherwise(F.col("last_timestamp")).alias("end_time_seconds"), F.when(known, hi - lo).alias("duration_seconds"),
        none("string").alias("reliability_status"), none("map<string,string>").alias("colour_attributes"), none("string").alias("motion_state"), none("string").alias("motion_direction"),
        none(place).alias("start_region"), none(place).alias("end_region"), none("string").alias("region_transition"),
        "relationship_types", "shared_frames", "near_ratio", "overlap_ratio", pair_sentence(F.col("track_a_class"), F.col("track_b_class"), F.col("relationship_types")).alias("description"), *more,
    )


def type_counts(events: DataFrame) -> DataFrame:
    """Events by type; rows stand for n events."""
    return events.groupBy("event_type").agg(F.sum("n").alias("events"))
