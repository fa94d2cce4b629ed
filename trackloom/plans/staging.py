"""Products written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a write go when it ends, not when their plan does.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, a temporary folder.
    On a cluster such a folder would be seen by one machine alone, so there it must be set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """The folder of all that this application stages."""
    return f"{shared_dir(spark)}/trackloom-staged/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    p, fs = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder was written, and its length."""
    p, fs = _path(spark, path)
    s = fs.getFileStatus(p)
    return s.getModificationTime(), s.getLen()


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the folder that nothing has been written to."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df (to a fresh path) and read it again: what several plans use is computed once,
    and the loss of an executor doesn't bring it back. What was shuffled for it goes then."""
    spark = df.sparkSession
    path = path or fresh(spark, name)
    had = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if had is None else spark.conf.set(FREED, had)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has staged; for its end."""
    delete(spark, folder(spark))
