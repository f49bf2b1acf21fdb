"""Mixing to target weights by soft membership.

A classifier trained on a labelled table predicts each document's posterior over domains.
Projected gradient descent then fits one non-negative rate per document, so that the expected
domain totals ``sum(rate * tokens * posterior)`` match the targets in the least-squares sense.
Rates are never stored between steps: a document's rate follows from its posterior and the
residuals of the steps so far, one short vector a step, so every step is one pass over the
posterior table that returns one sum per domain and one per pair of domains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import stored

BUCKETS = 1 << 16
REMEMBERED = 150_000


def _lookup():
    from zlib import crc32

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > REMEMBERED:
                self.clear()
            n = self[word] = crc32(word) % BUCKETS
            return n

    return Known().__getitem__


def fit_classifier(texts: list[bytes], labels: list[int], size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(log-odds by bucket and domain, log prior, scale): smoothed word rates, calibrated on a fifth."""
    at, counts = _lookup(), np.full((BUCKETS, size), 0.1)
    part = [np.fromiter(map(at, t.lower().split()), np.int64) for t in texts]
    for k, (ids, label) in enumerate(zip(part, labels, strict=True)):
        if k % 5 or len(texts) < 20:
            np.add.at(counts[:, label], ids, 1.0)
    rates = np.log(counts / counts.sum(axis=0))
    odds = rates - rates.mean(axis=1, keepdims=True)
    prior = np.log((np.bincount(labels, minlength=size) + 0.5) / (len(labels) + 0.5 * size))
    means = np.array([odds[ids].mean(axis=0) if len(ids) else np.zeros(size) for ids in part])
    tried = np.arange(len(texts)) % 5 == 0 if len(texts) >= 20 else np.ones(len(texts), bool)
    best, scale = np.inf, 1.0
    for candidate in (0.5, 1, 2, 4, 8, 16, 32, 64):
        logits = prior + candidate * means[tried]
        logits -= np.logaddexp.reduce(logits, axis=1, keepdims=True)
        loss = -logits[np.arange(tried.sum()), np.array(labels)[tried]].mean()
        if loss < best:
            best, scale = loss, float(candidate)
    return odds.astype(np.float32), prior, scale


def train(labelled: DataFrame, domains: list[str], text: str = "text", domain: str = "domain", max_docs: int = 4000) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit the classifier on about ``max_docs`` rows of (text, domain), those with the least hashes.

    Rows of other domains are left out; one task reads the bounded sample.
    """
    rows = labelled.select(F.col(text).cast("binary").alias("t"), F.col(domain).alias("d")).filter(F.col("d").isin(domains) & F.col("t").isNotNull())
    share = min(1.0, max_docs / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64(F.lit("mix"), "t"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    size = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((t, domains.index(d)) for b in batches for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        odds, prior, scale = fit_classifier([f[0] for f in found], [f[1] for f in found], size)
        yield pa.record_batch([pa.array([odds.tobytes()]), pa.array([prior.tobytes()]), pa.array([scale])], names=["odds", "prior", "scale"])

    row = rows.repartition(1).mapInArrow(run, "odds binary, prior binary, scale double").first()
    if row is None:
        return np.zeros((BUCKETS, size), np.float32), np.full(size, -np.log(size)), 1.0
    return np.frombuffer(row["odds"], np.float32).reshape(BUCKETS, size), np.frombuffer(row["prior"], np.float64), row["scale"]


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: Column, text: str = "text") -> DataFrame:
    """(key, tokens, posterior) of every row; a text without words has the prior."""
    odds, prior, scale = model
    held = docs.sparkSession.sparkContext.broadcast(odds)  # BUCKETS x domains floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights = _lookup(), held.value
        for batch in batches:
            sizes, logits = np.zeros(batch.num_rows, np.int64), np.tile(prior, (batch.num_rows, 1))
            for k, t in enumerate(batch.column(1)):
                words = (t.as_py() or b"").lower().split()
                if words:
                    sizes[k] = len(words)
                    logits[k] += scale * weights[np.fromiter(map(at, words), np.int64, len(words))].mean(axis=0, dtype=np.float64)
            chance = np.exp(logits - np.logaddexp.reduce(logits, axis=1, keepdims=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, chance.size + 1, len(prior)), pa.int32()), pa.array(chance.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(sizes), lists], names=["key", "tokens", "posterior"])

    rows = docs.select(key.alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, tokens long, posterior array<double>")


def rates_of(posterior: np.ndarray, steps: list[np.ndarray], least: float, most: float) -> np.ndarray:
    """Rates after the given steps: start at 1 (or the nearest bound), move, project onto the bounds."""
    rate = np.full(len(posterior), float(np.clip(1.0, least, most)))
    for step in steps:
        rate = np.clip(rate + posterior @ step, least, most)
    return rate


@dataclass
class Plan:
    """A fitted mixture: the steps that give each document's rate, and how close the totals came."""

    domains: list[str]
    least: float
    most: float
    steps: list[np.ndarray] = field(default_factory=list)
    target: np.ndarray | None = None
    reached: np.ndarray | None = None


def _totals(table: DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain, and how they answer to a step: the Gram matrix of the posteriors of free rates."""
    steps, least, most, size = plan.steps, plan.least, plan.most, len(plan.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            posterior, tokens = np.asarray(batch.column(1).flatten()).reshape(-1, size), np.asarray(batch.column(0))
            rate = rates_of(posterior, steps, least, most)
            total += (rate * tokens) @ posterior
            free = ((rate > least) | (not steps)) & (rate < most)
            gram += (posterior[free] * tokens[free, None]).T @ posterior[free]
        told = np.concatenate((total, gram.ravel()))
        yield pa.record_batch([pa.array(range(len(told)), pa.int32()), pa.array(told)], names=["d", "v"])

    rows = table.select("tokens", "posterior").mapInArrow(run, "d int, v double").groupBy("d").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size + size * size)
    for row in rows:
        out[row["d"]] = row["v"]
    return out[:size], out[size:].reshape(size, size)


def fit(table: DataFrame, targets: dict[str, float], domains: list[str], total: float | None = None, least: float = 0.0, most: float = float("inf"), rounds: int = 400, close: float = 1e-3) -> Plan:
    """Fit rates so that expected domain totals match ``targets`` (weights) of ``total`` tokens.

    ``total`` defaults to the tokens of the table.  With ``least`` of 1 or more and no total, it is
    the smallest that leaves no domain above its target, so that no document has to go.  Rates lie
    between ``least`` and ``most`` (unbounded if not given).

    Steps are least-squares gradients, first in the metric of the free rates, which is soon there, then plain
    ones of a length that always lowers the residual.  The fit ends when all residuals are within
    ``close`` of the total, or when a plain step lowers their norm by less than a thousandth: then the targets cannot be
    reached, and ``plan.reached`` tells the nearest totals found.  What is neither after ``rounds`` passes raises.
    """
    plan = Plan(domains, least, most)
    held, gram = _totals(table, Plan(domains, 1.0, 1.0 + 1e-9))
    weight = np.array([targets[d] for d in domains], np.float64)
    weight = weight / weight.sum()
    if total is None:
        total = float(held.sum()) if least < 1 else least * max((h / w for h, w in zip(held, weight, strict=True) if w > 0), default=0.0)
    plan.target = weight * total
    plan.reached, free = _totals(table, plan)
    plain = 1.8 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-9)
    length, small = 1.0, close * max(1.0, total)
    for _ in range(rounds):
        residual = plan.target - plan.reached
        if np.abs(residual).max(initial=0.0) <= small:
            return plan
        metric = length > 1 / 16
        plan.steps.append(length * (np.linalg.pinv(free, rcond=1e-9) @ residual) if metric else plain * residual)
        reached, answer = _totals(table, plan)
        if np.linalg.norm(plan.target - reached) < np.linalg.norm(residual) * (1 - 1e-3):
            plan.reached, free = reached, answer
        else:
            plan.steps.pop()
            if not metric:
                return plan
            length /= 4
    raise RuntimeError(f"the mixture did not settle: reached {plan.reached.tolist()} of {plan.target.tolist()}")


def rates(table: DataFrame, plan: Plan) -> DataFrame:
    """(key, tokens, posterior, rate) of every document."""
    steps, least, most, size = plan.steps, plan.least, plan.most, len(plan.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = np.asarray(batch.column("posterior").flatten()).reshape(-1, size)
            yield pa.record_batch([*batch.columns, pa.array(rates_of(posterior, steps, least, most))], names=[*batch.schema.names, "rate"])

    schema = T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())])
    return table.mapInArrow(run, schema)


def copies_of(rate: Column, *key: Column) -> Column:
    """The whole part of the rate, and one more with the chance of the rest, decided by the key's hash."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", **limits) -> tuple[DataFrame, Plan]:
    """((key, tokens, posterior, rate) of every row, plan).

    ``labelled`` has (text, domain).  Null and empty texts have the prior as posterior and no
    tokens; repeated rows have rates each; null keys stay; extra columns are ignored; an empty
    table gives an empty result.
    """
    domains = sorted(targets)
    table = stored(posteriors(docs, train(labelled, domains, text, domain), F.col(key), text), "posteriors")
    plan = fit(table, targets, domains, **limits)
    return rates(table, plan).withColumnRenamed("key", key), plan


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", domain: str = "domain", least: float = 1.0, **limits) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, in all their columns; no shuffle.

    With the default ``least`` of 1 every document stays and scarce domains are repeated.  Null and empty
    texts have the prior as posterior; repeated rows are repeated alike; an empty table stays empty.
    """
    domains = sorted(targets)
    model = train(labelled, domains, text, domain)
    # the pass over the texts is made once for the fit and once, joined to nothing, for the copies
    plan = fit(stored(posteriors(docs, model, F.lit(0), text), "posteriors"), targets, domains, least=least, **limits)
    odds, prior, scale = model
    held = docs.sparkSession.sparkContext.broadcast(odds)
    steps, most, schema, at = plan.steps, plan.most, docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        lookup, weights = _lookup(), held.value
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(at)]
            logits = np.tile(prior, (batch.num_rows, 1))
            for k, t in enumerate(texts):
                words = t.lower().split()
                if words:
                    logits[k] += scale * weights[np.fromiter(map(lookup, words), np.int64, len(words))].mean(axis=0, dtype=np.float64)
            posterior = np.exp(logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)).reshape(-1, len(prior))
            chance = np.array([zlib.crc32(t) / 2**32 for t in texts])
            copies = np.floor(rates_of(posterior, steps, least, most) + chance).astype(np.int64)
            yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))

    return docs.mapInArrow(run, schema)
