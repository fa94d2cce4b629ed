"""Writes: JSON products, keyed upserts, insert-if-absent, resets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.plans import staging
from trackloom.sources import schemas


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_document(rows: DataFrame, name: str = "tracks", **summary) -> DataFrame:
    """One JSON document {summary, name: [...]} for each video, the summary from aggregates over
    its rows; rows without a video_id are of one video."""
    totals = F.struct(*[c.alias(k) for k, c in summary.items()]).alias("summary")
    by = ["video_id"] if "video_id" in rows.columns else []
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in rows.columns if c not in by]))).alias(name)
    return rows.groupBy(*by).agg(totals, listed).select(*by, F.to_json(F.struct("summary", name)).alias("document"))


def upsert(target: DataFrame, incoming: DataFrame, key: str | list[str] = "document_id", order: str | None = None) -> DataFrame:
    """The target with the incoming rows put in their keys' places (a key may be of several
    columns); of several incoming rows
    of a key the last by `order` stays, and among equals one that a hash of the row decides on,
    so that a second run gives the same."""
    ranked = target.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    by = [F.col("_batch").desc()] + ([F.col(order).desc()] if order else []) + [F.xxhash64(F.to_json(F.struct(*target.columns)))]
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_n = 1").drop("_n", "_batch")


def absent(incoming: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key the target lacks, one for each key."""
    return incoming.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def insert_if_absent(incoming: DataFrame, spark: SparkSession, path: str, key: str) -> int:
    """Append what the table at path lacks; the number of rows that came in. The rows are made
    once and staged, so that those counted are those written, and the table isn't read while
    it is written."""
    new = staging.staged(absent(incoming, spark.read.parquet(path), key), "absent")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def append(df: DataFrame, path: str) -> DataFrame:
    """Add the rows to the table at path, whatever it holds; the whole table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_result(spark: SparkSession, response: dict, path: str) -> None:
    """Write a response of a search as one JSON document."""
    rows = spark.createDataFrame([(json.dumps(response, default=str),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)


def create_tables(spark: SparkSession, database: str | None = None) -> None:
    """The relational tables."""
    prefix = f"{database}." if database else ""
    for name, (columns, _) in schemas.RELATIONAL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet")


def reset(spark: SparkSession, table: str, columns: str) -> None:
    """Drop a collection and make it anew."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet")


def peek(df: DataFrame, n: int) -> DataFrame:
    return df.limit(max(0, n))
