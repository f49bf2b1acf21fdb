"""Exact de-duplication as a stateful stream, in DataFrame operations only.

A Structured Streaming aggregation keyed by the content digest keeps its state on disk
(RocksDB) and never expires it.  Per digest it retains the stable identifier of the row that
stays (the largest), the locator of that row's content (file and row index) and the number of
rows.  Rows whose digest was met more than once are hits: their whole bytes are compared with
those of the row that stays, found by its identifier, and any that differ (a digest collision) are
grouped by their bytes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import shared_dir, stored

#: State lives in RocksDB; a partition's store closes once its changes are in the shared folder,
#: since every open one holds some MB of preallocated local files however little it stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def _pattern(path: str) -> str:
    """A pattern that only ``path`` matches: the stream takes a single file by a pattern alone."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stream_digests(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest=sha256, per_batch: int = 16 << 30, state: str | None = None) -> DataFrame:
    """Read the Parquet table at ``path`` as a stream and return the final keyed state.

    Columns: digest, keep_id, file, row, group_size.  ``per_batch`` bounds the bytes that one
    micro-batch takes; running again with the same ``state`` folder takes only new files and
    goes on from the state held there.
    """
    home = state or shared_dir(spark, "exact")
    held = {name: spark.conf.get(name, None) for name in STATE}
    schema = spark.read.parquet(path).schema
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(per_batch)).parquet(_pattern(path))
        coded = rows.select(
            digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
            F.col(key).alias("id"),
            F.struct(F.col(key).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
        )
        kept = coded.groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("group_size"))

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{home}/changes/{number:06d}")

        query = kept.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    if not query.lastProgress or not any(p["numInputRows"] for p in query.recentProgress):
        at = T.StructType([T.StructField("id", schema[key].dataType), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
        if not state:
            return spark.createDataFrame([], T.StructType([T.StructField("digest", T.StringType()), T.StructField("at", at), T.StructField("group_size", T.LongType())])).select("digest", F.col("at.id").alias("keep_id"), "at.file", "at.row", "group_size")
    changes = spark.read.parquet(f"{home}/changes/*")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("at", "group_size"), "batch").alias("x"))
    return last.select("digest", F.col("x.at.id").alias("keep_id"), F.col("x.at.file").alias("file"), F.col("x.at.row").alias("row"), F.col("x.group_size").alias("group_size"))


def exact_duplicates(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest=sha256, per_batch: int = 16 << 30) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of the Parquet table at ``path``.

    Texts are equal when their bytes are; null counts as empty.  Of equal texts the row with the
    largest key stays.  Rows that repeat a key with equal text all count in group_size and all
    carry kept = true when theirs is the largest.  A null key never stays unless all keys of its
    group are null (then keep_id is null and kept is false).  Other columns are ignored; an empty
    table gives an empty result.
    """
    state = stored(stream_digests(spark, path, key, text, digest, per_batch), "digests").select("digest", "keep_id", "group_size")
    docs = spark.read.parquet(path).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("text"))

    # hits only: their bytes against those of the row that stays
    hits = stored(docs.join(state.filter("group_size > 1"), "digest"), "hits", compression="zstd")
    stays = hits.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("keep_text"))
    differing = hits.join(stays, "digest").filter(F.col("text") != F.col("keep_text")).select("digest")
    collided = stored(differing.distinct(), "collided")

    told = docs.select("id", "digest", sha.alias("sha")).join(state, "digest").select("digest", "id", "keep_id", "group_size", "sha")
    if not collided.isEmpty():
        apart = hits.join(collided, "digest", "left_semi").select("digest", "id", "text")
        groups = apart.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = apart.join(groups, ["digest", "text"]).select("digest", "id", "keep_id", "group_size", sha256(F.col("text")).alias("sha"))
        told = told.join(collided, "digest", "left_anti").unionByName(split)
    return told.select(F.col("id").alias(key), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))
