"""Annotation datasets: conversion, union, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.events import positions


def yolo_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Center and size by the frame's."""
    return [F.round((x + w / 2) / width, 6).alias("cx"), F.round((y + h / 2) / height, 6).alias("cy"), F.round(w / width, 6).alias("w"), F.round(h / height, 6).alias("h")]


def convert(annotations: DataFrame, categories: dict[int, int], width: int, height: int) -> DataFrame:
    """Annotations of known categories and real boxes, by frame, with the new class ids."""
    known = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    rows = annotations.withColumn("class_id", F.try_element_at(known, F.col("category"))).where("class_id IS NOT NULL AND w > 0 AND h > 0")
    return rows.select("frame", "class_id", *yolo_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(width), F.lit(height)))


def label_files(boxes: DataFrame) -> DataFrame:
    """The text of each frame's label file."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    return boxes.groupBy("frame").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("label"))


def union(datasets: dict[str, DataFrame]) -> DataFrame:
    """All datasets' images (split, stem, ...), renumbered within dataset and split."""
    out = None
    for prefix, df in datasets.items():
        one = df.withColumn("dataset", F.lit(prefix))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out = positions(out, [F.col("stem")], ["dataset", "split"], "_n")  # a split may be of any size
    number = (F.col("_n") - 1).cast("string")
    return out.withColumn("new_name", F.concat_ws("_", "dataset", "split", F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0")))).drop("_n")


def presence(datasets: dict[str, DataFrame], splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Which of the datasets have images in which splits: dataset, split, images, present."""
    out = None
    for name, df in datasets.items():
        wanted = df.sparkSession.createDataFrame([(name, s) for s in splits], "dataset string, split string")
        one = wanted.join(df.groupBy("split").agg(F.count("*").alias("images")), "split", "left")
        out = one if out is None else out.unionByName(one)
    return out.select("dataset", "split", F.coalesce("images", F.lit(0)).alias("images"), F.col("images").isNotNull().alias("present"))


def pairing(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and labels of each split, those without the other, and whether all match."""
    both = images.select("split", "stem", F.lit(1).alias("i")).join(labels.select("split", "stem", F.lit(1).alias("l")), ["split", "stem"], "full")
    image, label = F.col("i").isNotNull(), F.col("l").isNotNull()
    return both.groupBy("split").agg(
        F.count("i").alias("images"), F.count("l").alias("labels"), F.count_if(~label).alias("images_without_label"),
        F.count_if(~image).alias("labels_without_image"), F.bool_and(image & label).alias("complete"),
    )


def totals(boxes: DataFrame) -> DataFrame:
    """Boxes by split, with a grand total."""
    return boxes.rollup("split").agg(F.count("*").alias("boxes"))


def class_ids(labels: DataFrame, column: str = "line") -> DataFrame:
    return labels.select(F.split(F.trim(column), r"\s+")[0].try_cast("int").alias("class_id")).where("class_id IS NOT NULL").distinct()
