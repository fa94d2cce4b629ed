"""The stages of the corpus pipeline: each takes and, but for the last, gives documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import common, contamination, packing, quality, simhash, suffix


def keep_quality(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents scored at the threshold or more; the trees learn from this input.

    Null and empty texts are scored like any other, of repeated rows all stay or all go, other
    columns come through as they are; an empty table stays empty, and without labels all stays.
    """
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.where_scored(docs, trees, threshold)


def keep_one_of_near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the
    document with the smallest doc_id, and of its texts the least. Rows that share a doc_id and
    are near-duplicates of nothing all stay; so do rows without a doc_id."""
    groups = simhash.near_groups(docs, keyed=True).where("doc_id is not null")
    first = groups.groupBy("component").agg(F.min("doc_id").alias("doc_id"))
    kept = common.materialize(groups.join(first, ["component", "doc_id"]).groupBy("doc_id", "key", "component").agg(F.count("*").alias("rows")), "kept")
    # The ids grow with the input: never broadcast.
    out = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", simhash.text_key())
    out = out.join(kept.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("component").alias("__of")).hint("merge"), ["__id", "__key"])
    # One row of a component: only components with several rows of the id need an order.
    if kept.groupBy("doc_id", "component").agg(F.sum("rows").alias("rows")).where("rows > 1").limit(1).count():
        out = out.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__of").orderBy("text"))).where("__nth = 1")
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that also start in a document with a smaller
    doc_id. Characters that lose some of their bytes go as a whole; documents that are left
    with white space only go, unless they had nothing else before. Rows that share a doc_id don't
    cut each other; null texts stay null; other columns of any type come through as they are. The
    result is written, as the batches that it is made of are dropped at once."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Names of its own, so that no column can clash; values stay as they are.
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)] + [F.col("text").isNull().alias("none")]
    table = suffix.new_table(spark)
    found = suffix.remove_repeats(docs.select("doc_id", "text", F.struct(*held).alias("carry")), as_text=True, table=table)
    found = found.where((F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("kept", r"\s+", " "))) > 0))
    kinds = dict(docs.dtypes)
    values = {c: F.col("carry").getField(f"c{i}") for i, c in enumerate(rest)}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(values["n_chars"]).cast(kinds["n_chars"])
    values |= {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.when(~F.col("carry.none"), F.col("kept"))}
    out = common.materialize(found.select(*[values[c].alias(c) for c in docs.columns]), "cut")
    spark.sql(f"DROP TABLE {table}")
    return out


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with or without an item_id; null and empty texts hold
    none, repeated rows all stay or all go, other columns come through as they are."""
    return contamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of PRODUCTION limits (2048 ids):
    those of repeated rows each, of a null or empty text one id, of an empty table none."""
    return packing.packed(docs)
