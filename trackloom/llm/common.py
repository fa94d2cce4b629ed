"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



try:
    _c = ctypes.CDLL(None)
    # Large arrays go back to the system when they are freed. glibc raises the size from which
    # that holds with every large array, and so keeps a worker at the most it ever had.
    _c.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
except (OSError, AttributeError):  # another C library
    _c = None


def trim() -> None:
    """Give freed memory back to the system."""
    if _c is not None:
        _c.malloc_trim(0)


def tidy(run):
    """The function over batches, that gives back freed memory at the end of its task: workers
    are kept, and several may wait in an executor."""

    def go(batches):
        yield from run(batches)
        trim()

    return go


def tidy_table(run):
    """The same for a function over a group."""

    def go(table):
        out = run(table)
        trim()
        return out

    return go


def tidy_tables(run):
    """The same for a function over two groups."""

    def go(left, right):
        out = run(left, right)
        trim()
        return out

    return go


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset
    and all runs in one process (tests) a temporary folder that is then set for the session.
    On a cluster such a folder would be seen by one machine alone, so there it must be set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/trackloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:10]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives the
    loss of executors and makes what follows see one fixed set of rows."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through the file system that Spark itself uses for it."""
    p, fs = _folder(spark, path)
    fs.delete(p, True)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _folder(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    p, fs = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; extra columns of any name never reach an operator."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, end to end, and its n + 1 offsets.
    Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each value's UTF-8 bytes; nulls are empty."""
    data, off = flat_text(column)
    raw = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[a:b]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most bytes of the column (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    _, off = flat_text(col)
    start, n = 0, len(col)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """So many partitions of about `each` bytes for `size` bytes, 2 at least, and 50,000 at
    most: beyond 1 TB or so they grow instead (what is dealt out is taken up in slices)."""
    return min(50_000, max(2, -(-int(size) // each)))


def crc_fold(column="doc_id", folds: int = 5):
    """crc32 of the id as text, modulo folds. Null ids go by the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of data frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
