"""The corpus pipeline: from documents to packed training sequences.

Each stage works on all that its predecessor kept; between two stages the rows are written
as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import common, stages

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("SimHash near-dedup", stages.keep_one_of_near),
    ("suffix-array dedup", stages.cut_repeats),
    ("benchmark decontamination", stages.drop_leaks),
    ("best-fit packing", stages.pack_sequences),
]
#: Boosted trees, SimHash and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage-{k}")
    return docs
