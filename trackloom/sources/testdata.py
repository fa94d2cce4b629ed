"""Tracked observations made from the driver's events: one per user (track) and half hour
(frame), of one video or of several whose tracks have the same numbers. All numbers come from
integers, so that any engine gets the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import vocabulary as V

WIDTH, HEIGHT, FPS, FRAMES = 1920, 1080, 30.0, 1440

#: The same rows in SQL (as a list of common table expressions).
_OBS_SQL = """
ev AS (SELECT event_id, {video} AS video_id, {track} AS track_id, date_diff('second', TIMESTAMP '2024-01-01', ts) // 1800 AS frame_index, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
one AS (SELECT video_id, track_id, frame_index, min(event_id) AS obs_pos, min_by(k, event_id) AS k FROM ev GROUP BY video_id, track_id, frame_index),
obs AS (
  SELECT video_id, track_id, CAST(track_id % 7 AS INTEGER) AS class_id, (['pedestrian','people','bicycle','car','van','truck','bus'])[CAST(track_id % 7 AS INTEGER) + 1] AS class_name,
    min(obs_pos) OVER (PARTITION BY video_id, track_id) AS track_pos, obs_pos, frame_index, frame_index / 30.0 AS timestamp_seconds, (30 + k % 70) / 100.0 AS confidence,
    CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(x + 40 + track_id * 13 % 160 AS DOUBLE) AS x2, CAST(y + 40 + track_id * 29 % 140 AS DOUBLE) AS y2
  FROM (SELECT *, ((track_id * 97 + frame_index * (track_id % 7 - 3)) % 1700 + 1700) % 1700 AS x, ((track_id * 61 + frame_index * (track_id % 5 - 2)) % 900 + 900) % 900 AS y FROM one)
)
"""


def obs_sql(videos: int = 1) -> str:
    one = {"video": "'v0'", "track": "user_id"}
    several = {"video": f"'v' || CAST(user_id % {videos} AS VARCHAR)", "track": f"user_id // {videos}"}
    return _OBS_SQL.replace("{video}", (one if videos == 1 else several)["video"]).replace("{track}", (one if videos == 1 else several)["track"])


OBS_SQL = obs_sql()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, videos: int = 1) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, cast('2024-01-01' AS timestamp_ntz), cast(ts AS timestamp_ntz))")
    k = F.get_json_object("props", "$.k").cast("bigint")
    user = F.col("user_id")
    video, track = (F.lit("v0"), user) if videos == 1 else (F.concat(F.lit("v"), (user % videos).cast("string")), F.floor(user / videos))
    events = table(spark, sf_dir, "events").select("event_id", video.alias("video_id"), track.alias("track_id"), F.floor(seconds / 1800).alias("frame_index"), k.alias("k"))
    one = events.groupBy("video_id", "track_id", "frame_index").agg(F.min("event_id").alias("obs_pos"), F.min_by("k", "event_id").alias("k"))
    first = one.groupBy("video_id", "track_id").agg(F.min("obs_pos").alias("track_pos"))
    t, f = F.col("track_id"), F.col("frame_index")
    x = F.pmod(t * 97 + f * (t % 7 - 3), F.lit(1700))
    y = F.pmod(t * 61 + f * (t % 5 - 2), F.lit(900))
    return one.join(first, ["video_id", "track_id"]).select(
        "video_id", "track_id", (t % 7).cast("int").alias("class_id"), F.element_at(F.array(*map(F.lit, V.CLASSES)), (t % 7).cast("int") + 1).alias("class_name"),
        "track_pos", "obs_pos", "frame_index", (f / FPS).alias("timestamp_seconds"), ((30 + F.col("k") % 70) / 100.0).alias("confidence"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 40 + t * 13 % 160).cast("double").alias("x2"), (y + 40 + t * 29 % 140).cast("double").alias("y2"),
    )


def colors(spark: SparkSession, sf_dir: str, videos: int = 1) -> DataFrame:
    """A colour for each track: of clothing for humans, else of the object; some unknown."""
    t = F.col("track_id")
    names = F.array(*map(F.lit, COLOR_CYCLE))
    pick = lambda n: F.element_at(names, (n % len(COLOR_CYCLE)).cast("int") + 1)
    human = (t % 7) < 2
    rows = observations(spark, sf_dir, videos).select("video_id", "track_id").distinct()
    return rows.select("video_id", "track_id", F.when(~human, pick(t)).alias("object_color"), F.when(human, pick(t)).alias("upper_color"), F.when(human, pick(t * 3 + 1)).alias("lower_color"))


COLOR_CYCLE = ["black", "white", "gray", "red", "unknown", "blue", "green", "yellow", "white", "orange", "blue"]
COLORS_SQL = """
colors AS (
  SELECT video_id, track_id, CASE WHEN track_id % 7 >= 2 THEN cycle[track_id % 11 + 1] END AS object_color, CASE WHEN track_id % 7 < 2 THEN cycle[track_id % 11 + 1] END AS upper_color,
    CASE WHEN track_id % 7 < 2 THEN cycle[(track_id * 3 + 1) % 11 + 1] END AS lower_color
  FROM (SELECT DISTINCT video_id, track_id, ['black','white','gray','red','unknown','blue','green','yellow','white','orange','blue'] AS cycle FROM obs)
)
"""
