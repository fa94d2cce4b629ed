"""The event index: records, upserts, exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scoring as S
from trackloom.functions import text as T
from trackloom.plans import staging


def records(documents: DataFrame, vectors: DataFrame, on: str = "document_id") -> DataFrame:
    """Documents with their vectors; an error for a document without text. Arrays stay arrays
    and unknown times null; `flat` gives the form of stores that know neither."""
    d = documents.join(vectors.select(on, "embedding"), on)
    s, e = T.safe_double(F.col("start_time_seconds")), T.safe_double(F.col("end_time_seconds"))
    d = d.withColumn("start_time_seconds", s).withColumn("end_time_seconds", e)
    d = d.withColumn("duration_seconds", F.when((F.col("start_time_seconds") >= 0) & (F.col("end_time_seconds") >= 0), F.round(F.col("end_time_seconds") - F.col("start_time_seconds"), 4)))
    return d.withColumn("quality_score", T.safe_double(F.col("quality_score"), 0.0)).withColumn("document", F.when(F.trim("text") != "", F.col("text")).otherwise(F.raise_error(F.lit("a document without text"))))


def flat(index: DataFrame) -> DataFrame:
    """Lists joined by commas, -1 and "unknown" in place of nulls."""
    lists = {c: F.array_join(F.transform(F.array_compact(c), lambda x: x.cast("string")), ",") for c in ("track_ids", "class_names", "relationship_types") if c in index.columns}
    numbers = {c: F.coalesce(c, F.lit(-1.0)) for c in ("start_time_seconds", "end_time_seconds", "duration_seconds")}
    words = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")) for c in ("motion_state", "motion_direction", "region_transition", "reliability_status", "quality_label") if c in index.columns}
    return index.withColumns(lists | numbers | words)


def nearest(index: DataFrame, query: list[float], k: int, key: str = "document_id", metric: str = "cosine") -> DataFrame:
    """The k nearest rows, exactly: one pass with a heap in each task. Ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        d = S.cosine_distance(F.col("embedding"), q)
    else:
        d = F.aggregate(F.zip_with(F.col("embedding"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return index.withColumn("distance", d).orderBy("distance", key).limit(k)


def nearest_for_all(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", block: int = 4096) -> DataFrame:
    """The k nearest rows for each of a stated set of queries, in blocks of about `block`
    queries: a block is one pass over the index, in which a task keeps k candidates for each
    query. One block at a time is on the driver, and its results are written before the next."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    spark, out = index.sparkSession, None
    asked = queries.select(F.col(query_key).alias("query_id"), "embedding")
    blocks = max(1, -(-asked.count() // block))
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "neighbor")
    for at in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).toPandas()
        if not len(part):
            continue
        q = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        share = spark.sparkContext.broadcast((part["query_id"].to_numpy(), q))

        def run(batches, share=share):
            ids, q = share.value
            best_d, best_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.stack(b.column(1).to_pandas().to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                d = np.concatenate([best_d, 1 - q @ v.T], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(np.asarray(b.column(0)), (len(ids), b.num_rows))], axis=1)
                order = np.lexsort((i, np.round(d, 12)), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            n = best_d.shape[1]
            if n:
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": np.repeat(ids, n), "neighbor": best_i.ravel(), "distance": best_d.ravel()}), preserve_index=False)

        found = index.select(F.col(key).cast("long"), "embedding").mapInArrow(run, "query_id long, neighbor long, distance double")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if blocks > 1:
            found = staging.staged(found, "nearest")
            share.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, neighbor long, distance double, rank int") if out is None else out


def image_records(images: DataFrame, tracks: DataFrame) -> DataFrame:
    """Metadata of embedded crops: rank from the file name, id, description."""
    rank = F.when(F.col("image_name").startswith("rank_2"), 2).when(F.col("image_name").startswith("rank_3"), 3).otherwise(1)
    r = images.withColumn("rank", rank).withColumn("embedding_id", F.concat("track_id", F.lit("_rank_"), F.col("rank").cast("string"))).join(tracks, "track_id", "left")
    words = [c for c in ("object_type", "action", "orientation", "visibility") if c in tracks.columns]
    return r.withColumn("description", F.trim(F.concat_ws(" ", *[F.col(c) for c in words])))


def described(images: DataFrame) -> DataFrame:
    """Records for a plain append: without a description the track and the image name stand in."""
    fallback = F.concat_ws(" ", F.col("track_id").cast("string"), "image_name")
    return images.withColumn("description", F.coalesce(F.nullif(F.trim("description"), F.lit("")), fallback))
