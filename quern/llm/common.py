"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent on a single machine (tests) is a temporary folder made
    and set as the checkpoint folder; a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if current:
            base = current
        elif not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="quern-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key.replace("_", "."), value)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def held_out(key: Column, modulus: int, remainder: int = 2) -> Column:
    """True where the fold of ``key`` is the held-out one; a null key is not held out."""
    return F.coalesce(fold_of(key, modulus) == F.lit(remainder), F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on at most ``rows`` rows go to Python in one Arrow batch; a smaller setting stays.

    The JVM and the worker both hold the batches of whole texts several times over, beside each
    other in all tasks, outside the heap.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def open_fs(uri: str):
    """(filesystem, path) of a URI by pyarrow, for files that are not tables."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        rest = uri[len("file:"):]
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)
