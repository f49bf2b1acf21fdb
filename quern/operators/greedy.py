"""Greedy leaders of an edge table: the lexicographically first maximal independent set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only on a single machine."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that driver and executors share."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def leaders(pairs: DataFrame) -> DataFrame:
    """(node, kept) for the nodes of (a, b): a node goes if an earlier neighbour is kept.

    Each round keeps the undecided nodes without an undecided earlier neighbour and drops their
    later neighbours; rounds are as many as the longest rising chain of decisions.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    open_nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    decided = None
    while True:
        later = edges.select(F.col("b").alias("node")).distinct()
        kept = open_nodes.join(later, "node", "left_anti")
        dropped = edges.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        now = cut(kept.select("node", F.lit(True).alias("kept")).union(dropped.select("node", F.lit(False))))
        decided = now if decided is None else decided.union(now)
        settled = now.select("node")
        edges = cut(edges.join(settled.withColumnRenamed("node", "a"), "a", "left_anti").join(settled.withColumnRenamed("node", "b"), "b", "left_anti"))
        open_nodes = open_nodes.join(settled, "node", "left_anti")
        if edges.isEmpty():
            return decided.union(open_nodes.select("node", F.lit(True)))
