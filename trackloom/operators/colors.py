"""Colours: votes of pixels, consensus of crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import text as T

LEAST_PIXELS, LEAST_SHARE, LEAST_TRACK_SHARE = 150, 0.28, 0.32


def vote_weight(color: Column, saturation: Column) -> Column:
    """In hundredths: whole numbers, whose sums are exact in any order."""
    return F.when(color == "black", 45).when(color == "gray", 85).when(color == "white", 110).when(saturation > 90, 120).otherwise(100).cast("bigint")


def shares(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Each colour's share of the weight of its group, ranked (ties by name)."""
    votes = rows.groupBy(*keys, "color").agg(F.sum(weight).alias("votes"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return votes.withColumn("share", F.try_divide("votes", F.sum("votes").over(w))).withColumn("total", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.round("votes", 6).desc(), "color")))


def pixel_votes(pixels: DataFrame, keys: list[str], least: int = LEAST_PIXELS) -> DataFrame:
    """pixels (keys, h, s, v) -> primary, secondary, confidence and the four best scores."""
    named = pixels.withColumn("color", T.hsv_color(F.col("h"), F.col("s"), F.col("v")))
    ranked = shares(named, keys, vote_weight(F.col("color"), F.col("s")))
    out = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("place") == 1, F.col("color"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("color"))).alias("second"), F.max("share").alias("best"), F.max("total").alias("pixels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("place") <= 4, F.struct("color", F.round("share", 4).alias("score")))))).alias("scores"),
    )
    few = F.col("pixels") < least
    return out.select(
        *keys, F.when(few | (F.col("best") < LEAST_SHARE), "unknown").otherwise(F.col("first")).alias("primary_color"), F.when(~few, F.coalesce("second", "first")).otherwise("unknown").alias("secondary_color"),
        F.when(few, 0.0).otherwise(F.round("best", 4)).alias("confidence"), F.when(~few, F.col("scores")).alias("color_scores"), F.when(few, "insufficient_pixels").when(F.col("best") < LEAST_SHARE, "low_confidence").otherwise("ok").alias("reason"),
    )


def crop_weight(quality: Column, final_score: Column) -> Column:
    return F.greatest(F.lit(0.05), 0.6 * quality + 0.4 * final_score)


def crop_quality(variance: Column, width: Column, height: Column) -> Column:
    good = 0.65 * F.least(variance / 500, F.lit(1.0)) + 0.35 * F.least(width * height / 40000, F.lit(1.0))
    return F.when((width < 40) | (height < 40), 0.0).otherwise(good)


def consensus(crops: DataFrame, keys: list[str]) -> DataFrame:
    """crops (keys, primary_color, color_scores, weight) -> the colour of each track."""
    rows = crops.where("primary_color <> 'unknown'").select(*keys, "weight", F.explode("color_scores").alias("color", "score"))
    ranked = shares(rows, keys, F.col("score") * F.col("weight"))
    out = ranked.groupBy(*keys).agg(F.max(F.when(F.col("place") == 1, F.col("color"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("color"))).alias("second"), F.max("share").alias("best"))
    return out.select(*keys, F.when(F.round("best", 9) < LEAST_TRACK_SHARE, "unknown").otherwise(F.col("first")).alias("primary_color"), F.coalesce("second", "first").alias("secondary_color"), F.round("best", 4).alias("confidence"))


def color_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(F.coalesce("primary_color", F.lit("unknown")).alias("color")).agg(F.count("*").alias("tracks"))
