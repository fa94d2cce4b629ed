"""Semantic metadata of tracks: validation, aggregation, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import text as T

SCORED = ["colors", "attributes", "action"]


def valid(m: Column) -> Column:
    """All parts there, and the three confidences numbers from 0 to 1."""
    out = m.isNotNull()
    for part in ("colors", "attributes", "action", "orientation", "visibility", "confidence"):
        out = out & m[part].isNotNull()
    for part in SCORED:
        out = out & F.coalesce(F.try_element_at(m["confidence"], F.lit(part)).between(0, 1), F.lit(False))
    return F.coalesce(out, F.lit(False))


def validity(rows: DataFrame, column: str = "metadata") -> DataFrame:
    return rows.withColumn("valid", valid(F.col(column)))


def validity_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def normalized(rows: DataFrame) -> DataFrame:
    """Colours and attributes by their synonyms, of flat metadata columns."""
    return rows.withColumn("colors", F.transform_values("colors", lambda _, v: T.normal_color(v))).withColumn("attributes", T.normal_attributes(F.col("attributes")))


def cleaned(rows: DataFrame) -> DataFrame:
    """Without stop values."""
    return rows.withColumns({"attributes": T.clean_attributes(F.col("attributes")), "colors": T.clean_colors(F.col("colors")), "action": T.clean_action(F.col("action"))})


def modes(rows: DataFrame, keys: list[str], columns: list[str], position: str) -> DataFrame:
    """The most frequent value of each column in each group, ties to the first seen. All
    columns in one exchange by the group's keys."""
    named = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns])
    long = rows.select(*keys, position, F.explode(named).alias("x")).select(*keys, position, "x.*").where("value IS NOT NULL")
    counted = long.groupBy(*keys, "what", "value").agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    best = counted.groupBy(*keys, "what").agg(F.max_by("value", F.struct("n", (-F.col("seen")).alias("early"))).alias("value"))
    return best.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == c, F.col("value"))).alias(c) for c in columns])


def aggregate(rows: DataFrame) -> DataFrame:
    """rows (track_id, position, object, action, orientation, visibility, colors, attributes,
    confidence, start_time, end_time, duration) -> one row per track."""
    mode = modes(rows, ["track_id"], ["object", "action", "orientation", "visibility"], "position")
    newest = F.struct("position", "value")
    named = rows.select("track_id", "position", F.explode("colors").alias("name", "value"))
    last = named.groupBy("track_id", "name").agg(F.max(newest)["value"].alias("value"))
    colors = last.groupBy("track_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("colors"))
    attributes = rows.select("track_id", F.explode("attributes").alias("a")).groupBy("track_id").agg(F.array_sort(F.collect_set("a")).alias("attributes"))
    start, end = F.min("start_time"), F.max("end_time")
    rest = rows.groupBy("track_id").agg(
        F.count("*").alias("samples"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 3).alias("confidence"), start.alias("start_time"), end.alias("end_time"),
        F.coalesce(end - start, F.avg("duration")).alias("duration"),
    )
    out = rest.join(mode, "track_id", "left").join(colors, "track_id", "left").join(attributes, "track_id", "left")
    return out.withColumn("start_timestamp", T.clock(F.col("start_time"), always_hours=True)).withColumn("end_timestamp", T.clock(F.col("end_time"), always_hours=True))


def grouped_events(tracks: DataFrame) -> DataFrame:
    """Tracks by object and action, in lists: for what one video holds. A corpus keeps to
    `event_members`, whose groups may be of any size."""
    return tracks.groupBy(F.concat_ws("_", F.coalesce("object", F.lit("unknown")), F.coalesce("action", F.lit("unknown"))).alias("event")).agg(F.count("*").alias("count"), F.array_sort(F.collect_list("track_id")).alias("track_ids"))


def event_members(tracks: DataFrame) -> DataFrame:
    """The event of each track, a row each."""
    return tracks.select(F.concat_ws("_", F.coalesce("object", F.lit("unknown")), F.coalesce("action", F.lit("unknown"))).alias("event"), "track_id")


def export(rows: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The five products of valid answers (rows as `aggregate` takes them), written as JSON lines
    below folder and read again: objects, tracks, events, semantic (of both), statistics."""
    spark, out = rows.sparkSession, {}

    def product(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").json(f"{folder}/{name}")
        out[name] = spark.read.schema(df.schema).json(f"{folder}/{name}")

    product("object_metadata", normalized(rows))
    product("track_metadata", aggregate(out["object_metadata"]))
    product("event_metadata", grouped_events(out["track_metadata"]))
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
    product("semantic_metadata", one("track", out["track_metadata"]).unionByName(one("event", out["event_metadata"])))
    product("statistics", statistics(out["track_metadata"]))
    return out


def statistics(tracks: DataFrame) -> DataFrame:
    """How often each object, action, attribute and colour occurs: one pass over all four."""
    one = lambda kind, c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    many = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    colors = F.coalesce(F.map_values("colors"), F.array().cast("array<string>"))
    every = F.concat(one("object", "object"), one("action", "action"), many("attribute", F.col("attributes")), many("color", colors))
    return tracks.select(F.explode(every).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def fuse(tracks: DataFrame, semantic: DataFrame, objects: DataFrame, events: DataFrame) -> DataFrame:
    """The four products of each video as one document; rows without a video_id are of one video."""
    parts = None
    for name, df in (("tracks", tracks), ("semantic", semantic), ("objects", objects), ("events", events)):
        video = F.col("video_id") if "video_id" in df.columns else F.lit("")
        one = df.select(video.alias("video_id"), F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("row"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("video_id").pivot("part", ["tracks", "semantic", "objects", "events"]).agg(F.array_sort(F.collect_list("row")))


def track_context(vlm: DataFrame, tracking: DataFrame) -> DataFrame:
    """Class and times of the track that a crop folder's name ends in the number of."""
    number = F.substring_index("track_folder", "_", -1).try_cast("bigint")
    return vlm.withColumn("track_id", number).join(tracking.select("track_id", "class_name", "start_time", "end_time"), "track_id", "left")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
