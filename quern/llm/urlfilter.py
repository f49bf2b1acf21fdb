"""URL verdicts: host-and-path rules first, a character language-model ratio for the rest.

All distinct URLs that a rule decides are learned from: four fifths by hash are counted, the rest
calibrates the threshold.  One variable-order Markov model of the bytes of accepted URLs and one
of rejected URLs are smoothed by Witten-Bell interpolation down to the uniform distribution;
contexts seen once are left to their shorter suffix.  The verdict compares the log-likelihood
difference per byte with a threshold calibrated on the URLs that the models haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, stored
from quern.operators.export import running_before

#: The production rules: (verdict, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A gram's length is above this bit, its bytes are below: bytes and their contexts are numbers.
LENGTH = 56
#: Distinct grams that a task holds before it passes their counts on.
HELD = 1 << 20


def joined(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column one after the other, and the offsets of its values; null counts as empty."""
    urls = urls.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset : urls.offset + len(urls) + 1]
    data = np.frombuffer(urls.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of context from 0: the bytes that have one so long before them, the contexts and the events (context and byte) of all."""
    value, context = data.astype(np.int64), np.zeros(len(data), np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for n in range(order + 1):
        if n:
            context[n:] += value[:-n] << 8 * (n - 1)
        yield place >= n, context | n << LENGTH, context << 8 | value | n << LENGTH


def context_of(events: np.ndarray) -> np.ndarray:
    """The contexts of events."""
    return (events & (1 << LENGTH) - 1) >> 8 | events >> LENGTH << LENGTH


@dataclass
class MarkovModel:
    """Interpolated variable-order byte model in sorted arrays; ``order``, at most 6, is the longest context."""

    order: int = 4
    events: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __post_init__(self) -> None:
        """Totals and kinds of the contexts; those seen once are left out, except the empty one."""
        told = self.counts > 0
        self.events, self.counts = self.events[told], self.counts[told]
        self.contexts, starts, self.kinds = np.unique(context_of(self.events), return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, starts) if len(starts) else self.counts
        kept = (self.totals > 1) | (self.contexts == 0)
        stays = np.repeat(kept, self.kinds)
        self.events, self.counts = self.events[stays], self.counts[stays]
        self.contexts, self.totals, self.kinds = self.contexts[kept], self.totals[kept], self.kinds[kept]

    def fit(self, urls: list[bytes]) -> MarkovModel:
        found = [event[has] for has, _, event in grams(*joined(pa.array(urls, pa.binary())), self.order)]
        return MarkovModel(self.order, *np.unique(np.concatenate(found), return_counts=True))

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The chance of every byte after those before it in its URL."""
        chance = np.full(len(data), 1 / 256)
        if not len(self.events):
            return chance
        for has, context, event in grams(data, offsets, self.order):
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            has &= self.contexts[at] == context
            place = np.minimum(np.searchsorted(self.events, event), len(self.events) - 1)
            seen = np.where(self.events[place] == event, self.counts[place], 0)
            chance = np.where(has, (seen + self.kinds[at] * chance) / (self.totals[at] + self.kinds[at]), chance)
        return chance

    def chance(self, context: bytes, byte: int) -> float:
        text = np.frombuffer(context + bytes([byte]), np.uint8)
        return float(self.chances(text, np.array([0, len(text)]))[-1])


@dataclass
class Ratio:
    """Log-likelihood difference per byte of two models."""

    accepted: MarkovModel
    rejected: MarkovModel

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Of every URL of a binary column; 0 for null and empty ones."""
        data, offsets = joined(urls)
        out, sizes = np.zeros(len(urls)), np.diff(offsets)
        if len(data):
            each = np.log(self.accepted.chances(data, offsets) / self.rejected.chances(data, offsets))
            some = sizes > 0
            out[some] = np.add.reduceat(each, offsets[:-1][some]) / sizes[some]
        return out


def count_grams(urls: DataFrame, order: int) -> DataFrame:
    """(event, good, bad): how often the URLs of (url, verdict) hold each event, of contexts seen more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, ...]:
            events, good, bad = (np.concatenate(x) for x in zip(*held, strict=True))
            events, at = np.unique(events, return_inverse=True)
            return events, np.bincount(at, good, len(events)).astype(np.int64), np.bincount(at, bad, len(events)).astype(np.int64)

        def told(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(context_of(columns[0])), *map(pa.array, columns)], names=["context", "event", "good", "bad"])

        for batch in batches:
            data, offsets = joined(batch.column(0))
            good = np.repeat(np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool), np.diff(offsets))
            for has, _, event in grams(data, offsets, order):
                for side in (True, False):
                    events, n = np.unique(event[has & (good == side)], return_counts=True)
                    held.append((events, n if side else 0 * n, 0 * n if side else n))
                    size += len(events)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield told(held[0])
                    held, size = [], 0
        if held:
            yield told(merged())

    found = urls.select(F.col("url").cast("binary"), (F.col("verdict") == "allow").alias("good")).mapInArrow(run, "context long, event long, good long, bad long")
    sums = found.repartition("context").groupBy("context", "event").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    of_context = Window.partitionBy("context")
    totals = sums.withColumns({"g": F.sum("good").over(of_context), "b": F.sum("bad").over(of_context)})
    return totals.filter((F.col("context") == 0) | (F.col("g") > 1) | (F.col("b") > 1)).select("event", "good", "bad")


def calibrate(scored: DataFrame) -> float:
    """The threshold of best balanced accuracy of (score, good, bad) rows with distinct scores; scores at or above it are accepted.

    Of equal thresholds it is the least; it lies half-way to the next lower score.
    """
    n = scored.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n["good"] or not n["bad"]:
        return float("-inf") if not n["bad"] else float("inf")
    weighed = scored.select("score", (F.col("bad") * F.lit(n["good"]) - F.col("good") * F.lit(n["bad"])).cast("long").alias("gain"))
    best = running_before(weighed, None, "score", "gain", "below").orderBy(F.desc("below"), "score").first()["score"]
    under = scored.filter(F.col("score") < best).agg(F.max("score")).first()[0]
    return best if under is None else (under + best) / 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent domain and starts the path; null for none."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def train(labelled: DataFrame, order: int = 4) -> tuple[Ratio, float]:
    """(ratio, threshold) from all distinct rows of (url, verdict); null URLs are left out.

    A fifth, by hash, calibrates the threshold and the models are counted from the others; where
    one of these parts lacks a verdict that the rows have, all rows serve for both.  The counts of
    the contexts seen more than once come to the driver, 24 bytes for each distinct event.
    """
    urls = labelled.filter("url IS NOT NULL").select("url", "verdict").distinct().withColumn("held", F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    urls = stored(urls, "urls")
    parts = {(r["verdict"], r["held"]) for r in urls.select("verdict", "held").distinct().collect()}
    apart = all((v, part) in parts for v, _ in parts for part in (True, False))
    counts = count_grams(urls.filter("NOT held") if apart else urls, order).toArrow().sort_by("event")
    events, good, bad = (counts[c].to_numpy() for c in ("event", "good", "bad"))
    ratio = Ratio(MarkovModel(order, events, good), MarkovModel(order, events, bad))
    models = urls.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(models.value.scores(batch.column(0))), batch.column(1)], names=["score", "good"])

    kept = (urls.filter("held") if apart else urls).select(F.col("url").cast("binary"), (F.col("verdict") == "allow").cast("long").alias("good"))
    scored = stored(kept.mapInArrow(run, "score double, good long").groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "scores")
    at = calibrate(scored)
    discard(urls)
    discard(scored)
    return ratio, at


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None, order: int = 4) -> DataFrame:
    """(key, host, path, rule, verdict, ratio) of every row.

    ``labelled`` (url, verdict) trains the models; by default the URLs that the rules decide do.
    ``ratio`` is the length-normalised log-likelihood difference of every URL, 0 for null and empty
    ones.  Without rejected examples all the rest is allowed, without accepted ones (but rejected)
    all is blocked.  Repeated rows stay; extra columns are ignored; an empty table gives none.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    told = F.lit(None).cast("string")
    for verdict, rule in rules:
        told = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(told)
    rows = rows.withColumn("told", told)
    ratio, at = train(rows.filter("told IS NOT NULL").select("url", F.col("told").alias("verdict")) if labelled is None else labelled, order)
    held = pages.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.scores(batch.column("url"))
            own = pa.array(np.where(scores >= at, "allow", "block"), pa.string())
            yield pa.record_batch([batch.column("id"), batch.column("host"), batch.column("path"), batch.column("rule"), pc.coalesce(batch.column("told"), own), pa.array(scores, pa.float64())], names=["id", "host", "path", "rule", "verdict", "ratio"])

    kind = pages.schema[key].dataType.simpleString()
    rows = rows.withColumn("url", F.col("url").cast("binary"))
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, ratio double").withColumnRenamed("id", key)
