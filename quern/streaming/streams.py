"""Structured Streaming forms of the pipeline: file sources, stateful de-duplication, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import exact_hash


def files(spark: SparkSession, path: str, schema, form: str = "json", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; the checkpoint keeps the offsets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_trigger)).format(form).load(path)


def distinct_documents(stream: DataFrame, text: str = "text") -> DataFrame:
    """The first row of each exact hash, over the whole life of the stream."""
    return stream.withColumn("exact_hash", exact_hash(F.col(text))).dropDuplicates(["exact_hash"])


def event_counts(stream: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in event-time windows; events later than ``late`` are left out."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), user).agg(F.count(F.lit(1)).alias("n"))


def joined(left: DataFrame, right: DataFrame, key: str, at: str = "ts", within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs of events of two streams with one key, the right one at most ``within`` after the left; watermarks bound the state."""
    a = left.withWatermark(at, late).select([F.col(c).alias(f"left_{c}") for c in left.columns])
    b = right.withWatermark(at, late).select([F.col(c).alias(f"right_{c}") for c in right.columns])
    time = F.expr(f"right_{at} >= left_{at} AND right_{at} <= left_{at} + INTERVAL {within}")
    return a.join(b, (F.col(f"left_{key}") == F.col(f"right_{key}")) & time)


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch writer that hands each batch to every given one, in order."""

    def put(batch: DataFrame, number: int) -> None:
        for write in writers:
            write(batch, number)

    return put


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there in micro-batches and stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def split_batches(accepted: str, rejected: str, rule: str = "rule") -> Callable[[DataFrame, int], None]:
    """A batch writer with two outputs; each batch has folders of its own, so that a repeat overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.filter(F.col(rule).isNull()).write.mode("overwrite").json(f"{accepted}/batch={number}")
            held.filter(F.col(rule).isNotNull()).write.mode("overwrite").json(f"{rejected}/batch={number}")
        finally:
            held.unpersist()

    return put
