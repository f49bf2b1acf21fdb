"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.llm.common import discard, stored


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored edges, and their number and digest as the writing saw them."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "cc")
    return out, (seen.get["n"], seen.get["x"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands its (larger / not larger) neighbours to its least neighbour.

    The least neighbour comes from an aggregate that combines before the shuffle and is
    joined back, so that a node with very many neighbours is split by the skew join.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("m", "u").alias("m"))
    met = both.join(least, F.col("u") == F.col("mu"))
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("mu"), F.col("m")))
    return out.filter(F.col("a") != F.col("b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node that has an edge.

    ``edges`` has two integer columns; nulls and self-loops are ignored, direction and
    repetition don't matter, an empty table gives an empty result.  Each round is written
    to the shared folder, so a lost executor costs a re-read and lineage stays short.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    now = now.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = _written(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, (now, after) = now, _written(_star(_star(now, True), False).distinct())
        discard(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
