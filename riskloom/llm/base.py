"""What every training-data operator shares: reading, shared scratch space, checks."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text an Arrow batch carries at most (a longer single row still travels whole).
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a private one in local mode alone (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/riskloom-{spark.sparkContext.applicationId}"  # one folder an application, so that one removal clears it


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, on storage
    that survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by `saved` that no plan to come reads again."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run):
    """`run` of a mapInArrow, giving what it freed back to the system when its task ends.

    Python workers outlive their tasks: without this, what one stage needed adds to the next one's memory."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def released() -> None:
    """Give this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def text_or_empty(docs: DataFrame, *extra: str, key: str = "doc_id") -> DataFrame:
    """doc_id and text only (clashing extra columns never get further); null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def fold(key: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus
