import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra: bool = False):
    """(doc_id, text) -> documents; extra: further columns with names that operators use."""
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    if extra:
        for c in ("fp", "bucket", "length", "piece", "ids", "batch", "rank", "quality_score", "row"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def table(df) -> pd.DataFrame:
    return df.toPandas()
