"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is toxic if at least one of its sentences is, so its score is
``1 - prod(1 - p(sentence))``.  Sentence scores come from a logistic model of word features
(the word and its first three to six letters, hashed), trained by gradient descent through the noisy-or from
document labels alone; afterwards the same sentence scores locate the offending sentences.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import held_out

SPLIT = r"[.!?\n\r 。！？]+"
BUCKETS = 1 << 20
#: Words whose weight a worker remembers before it starts anew.
REMEMBERED = 150_000


def word_features(word: str) -> list[int]:
    """Hash buckets of a lower-cased word: itself and its prefixes of three to six letters."""
    from zlib import crc32

    core = word.strip("\"'`.,;:!?()[]{}<>*#%&|/\\-_=+~^$@’“”«»")
    if not core:
        return []
    names = ["w " + core] + [f"p{core[:n]}" for n in range(3, min(6, len(core)) + 1)]
    return [crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


def select_features(seen: list[np.ndarray], labels: np.ndarray, least: float = 4.0, most: int = 20_000) -> np.ndarray:
    """Buckets whose document frequency (``seen`` by label) is ``least`` standard errors higher in toxic documents."""
    n1, n0 = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    p1, p0 = seen[1] / n1, seen[0] / n0
    mean = (seen[1] + seen[0] + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    z[seen[1] < 3] = 0
    chosen = np.flatnonzero(z >= least)
    return chosen[np.argsort(-z[chosen], kind="stable")][:most]


def fit_noisy_or(rows: np.ndarray, columns: np.ndarray, sentence_doc: np.ndarray, rest: np.ndarray, labels: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """(bias, weights): Adam on the noisy-or log-loss.

    ``rows``/``columns`` pair sentences with features, ``sentence_doc`` maps sentences to documents
    and ``rest`` counts each document's sentences without any feature.
    """
    theta = np.concatenate(([-7.0], np.full(width, 1.0)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    n = max(1, len(labels))
    for step in range(1, steps + 1):
        z = theta[0] + np.bincount(rows, theta[1 + columns], len(sentence_doc)) if len(rows) else np.full(len(sentence_doc), theta[0])
        rise = np.logaddexp(0, z)
        total = np.bincount(sentence_doc, rise, len(labels)) + rest * np.logaddexp(0, theta[0])
        slope = np.where(labels > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) / n
        slope = np.maximum(slope, -1e3)
        inner = slope[sentence_doc] / (1 + np.exp(-z))
        grad = np.empty(width + 1)
        grad[0] = inner.sum() + (slope * rest).sum() / (1 + np.exp(-theta[0]))
        grad[1:] = np.bincount(columns, inner[rows], width) if len(rows) else 0
        grad[1:] += ridge * theta[1:] / max(1, width)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        theta[0] = min(theta[0], -3.0)
    return float(theta[0]), theta[1:]


def train_bags(texts: list[str], labels: np.ndarray) -> tuple[float, dict[int, float]]:
    """(bias, weight by bucket) from whole texts and their labels."""
    import re

    split = re.compile(SPLIT).split
    seen = [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]
    known: dict[str, array] = {}
    for text, label in zip(texts, labels, strict=True):
        found = array("i")
        for word in set(text.lower().split()):
            ids = known.get(word)
            if ids is None:
                if len(known) > REMEMBERED // 4:
                    known.clear()
                ids = known[word] = array("i", word_features(word))
            found.extend(ids)
        seen[int(label)][np.unique(np.frombuffer(found, np.int32))] += 1
    del known
    chosen = select_features(seen, labels)
    place = {int(b): k for k, b in enumerate(chosen)}
    places: dict[str, tuple[int, ...]] = {}
    rows, columns, owner, rest = [], [], [], np.zeros(len(texts))
    for at, text in enumerate(texts):
        for sentence in split(text.lower()):
            words = sentence.split()
            if not words:
                continue
            active = []
            for word in words:
                hit = places.get(word)
                if hit is None:
                    if len(places) > REMEMBERED // 4:
                        places.clear()
                    hit = places[word] = tuple(place[f] for f in word_features(word) if f in place)
                active += hit
            if active:
                rows += [len(owner)] * len(active)
                columns += active
                owner.append(at)
            else:
                rest[at] += 1
    bias, weights = fit_noisy_or(np.array(rows, np.int64), np.array(columns, np.int64), np.array(owner, np.int64), rest, labels, len(chosen))
    return bias, {int(b): float(w) for b, w in zip(chosen, weights, strict=True)}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, max_docs: int = 8000) -> tuple[float, dict[int, float]]:
    """Train on at most about ``max_docs`` labelled documents outside the held-out fold.

    The sample takes the documents whose key hashes lowest; it is read by one task, which returns
    the chosen weights only.  Without labelled rows of both kinds nothing is toxic.
    """
    told = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    told = told.filter(~held_out(F.col("k"), modulus)).groupBy("k").agg(F.max("y").alias("y"))
    n = told.count()
    share = min(1.0, max_docs / max(1, n))
    told = told.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("k")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(told, "k").select("k", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(k, t, y) for b in batches for k, t, y in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)]
        found.sort(key=lambda r: (r[0], r[1]))
        y = np.array([r[2] for r in found], np.float64)
        bias, weights = train_bags([r[1] for r in found], y) if 0 < y.sum() < len(y) else (-20.0, {})
        yield pa.record_batch([pa.array([bias]), pa.array([list(weights)], pa.list_(pa.int64())), pa.array([list(weights.values())], pa.list_(pa.float64()))], names=["bias", "buckets", "weights"])

    rows = sample.repartition(1).mapInArrow(run, "bias double, buckets array<long>, weights array<double>").collect()
    return (rows[0]["bias"], dict(zip(rows[0]["buckets"], rows[0]["weights"], strict=True))) if rows else (-20.0, {})


class Scorer:
    """Noisy-or scores of whole texts and their offending sentences."""

    def __init__(self, bias: float, weights: dict[int, float], offending: float = 0.3) -> None:
        import re
        from math import exp, log1p

        self.bias, self.offending = bias, offending
        self.split, self.spans = re.compile(SPLIT).split, re.compile(rf"(?:(?!{SPLIT[:-1]}).)+", re.S).finditer
        self.log1p, self.exp = log1p, exp
        self.quiet = log1p(exp(bias))

        class Table(dict):
            def __missing__(self, word: str) -> float:
                value = sum(weights.get(f, 0.0) for f in word_features(word))
                if len(self) > REMEMBERED:
                    self.clear()
                self[word] = value
                return value

        self.table = Table()

    def rise(self, weight: float) -> float:
        z = self.bias + weight
        return z if z > 30 else self.log1p(self.exp(z))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, [(start, end, sentence score)]) of one text."""
        weigh, total, hit = self.table.__getitem__, 0.0, False
        for sentence in self.split(text.lower()):
            words = sentence.split()
            if words:
                weight = sum(map(weigh, words))
                if weight:
                    up = self.rise(weight)
                    hit = hit or up > 0.01
                    total += up
                else:
                    total += self.quiet
        found = []
        if hit:
            for m in self.spans(text):
                chance = 1 - self.exp(-self.rise(sum(map(weigh, m.group().lower().split()))))
                if chance >= self.offending:
                    found.append((m.start(), m.end(), chance))
        return 1 - self.exp(-total), found


def score_documents(docs: DataFrame, model: tuple[float, dict[int, float]], key: str = "doc_id", text: str = "text", modulus: int = 4, threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted, sentences) of every row.

    ``sentences`` lists start, end and score of each offending sentence in characters of the text.
    Null and empty texts score 0; repeated rows score alike; a null key is not held out; extra
    columns are ignored; an empty table gives an empty result.
    """
    bias, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bias, weights, threshold)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            told = [scorer.score(t.as_py() or "") for t in batch.column(2)]
            scores = np.array([s for s, _ in told], np.float64)
            spans = pa.array([[{"start": a, "end": b, "score": c} for a, b, c in f] for _, f in told], span)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), spans], names=["key", "held_out", "score", "predicted", "sentences"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key), modulus).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, model: tuple[float, dict[int, float]], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in all their columns; no shuffle."""
    bias, weights = model
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bias, weights, threshold)
        for batch in batches:
            keep = pa.array([scorer.score(t.as_py() or "")[0] < threshold for t in batch.column(at)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, schema)
