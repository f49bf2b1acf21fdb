"""Katz backoff language model with Good-Turing discounts, trained and evaluated on the cluster.

Tokens are the words of a text (A-Z lower-cased, split at ASCII white space) and one end token,
which is also the history of a text's first token.  ``P(w|h) = d(c(hw)) c(hw) / c(h)`` for seen
pairs and ``alpha(h) P(w)`` for others; ``P(w) = d(c(w)) c(w) / N`` for known words, and what that
leaves goes to the one class of unknown words.  ``alpha(h)`` normalises each history exactly.

Nothing whose size follows the vocabulary leaves the executors: the driver sees one row per
distinct word *count* (at most the square root of twice the tokens).

* ``chunks``: every task reduces its documents to local word ids and a local vocabulary.
* Words get global ids by falling count, so that an id alone tells the word's count, and the ids
  return to the chunks.
* Chunks send their distinct pairs to buckets by history (the pairs of histories that hold more than
  a bucket's share go by the whole pair); buckets sum the counts, store the model, and
  answer every chunk with the counts of its pairs and the sums that ``alpha`` of its histories needs.
* Chunks evaluate their tokens from the answers, backing off from pair to word to unknown word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import discard, held_out, shared_dir, shuffle_partitions, stored

UNKNOWN = 0xFFFFFFFF
#: Good-Turing discounts apply to counts up to this one.
TOP = 5
#: Tokens after which a chunk ends.
CHUNK = 4_000_000


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of 32-bit integers, each as four planes of bytes, compressed together."""
    import zstandard

    planes = [np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, sizes: list[int]) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=4 * sum(sizes) + 1), np.uint8)
    out, at = [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").reshape(-1))
        at += 4 * n
    return out


def discounts(counts: dict[int, int]) -> np.ndarray:
    """d(0..TOP+1) from the counts of counts; the last stands for all larger counts.

    Good-Turing where it is defined and between 0 and 1, absolute discounting elsewhere.
    """
    n = [counts.get(r, 0) for r in range(TOP + 2)]
    out = np.ones(TOP + 2)
    cut = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    flat = min(max(flat, 0.05), 0.95)
    for r in range(1, TOP + 1):
        if n[r] and n[r + 1] and cut < 1:
            out[r] = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
        if not 0 < out[r] < 1:
            out[r] = (r - flat) / r
    return out


@dataclass
class Unigrams:
    """All that word-level evaluation needs, from the counts of counts."""

    values: np.ndarray  # distinct counts, falling
    ends: np.ndarray  # ids below ends[k] have a count of at least values[k]
    total: int
    size: int
    discount: np.ndarray
    left: float

    @classmethod
    def of(cls, counts: dict[int, int]) -> Unigrams:
        values = np.array(sorted(counts, reverse=True), np.int64)
        kinds = np.array([counts[int(v)] for v in values], np.int64)
        total = int((values * kinds).sum())
        discount = discounts(counts)
        seen = (kinds * values * discount[np.minimum(values, TOP + 1)]).sum() / total if total else 0.0
        if seen >= 1:  # no count is discounted: all yield one part in N + 1
            discount = discount * total / (total + 1)
            seen = total / (total + 1)
        return cls(values, np.cumsum(kinds), total, int(kinds.sum()), discount, 1 - seen)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """c(w); 0 for unknown words."""
        at = np.searchsorted(self.ends, ids, side="right")
        return np.concatenate((self.values, [0]))[at]

    def chances(self, counts: np.ndarray) -> np.ndarray:
        known = counts * self.discount[np.minimum(counts, TOP + 1)] / max(1, self.total)
        return np.where(counts > 0, known, self.left)


def deal(history: np.ndarray, word: np.ndarray, buckets: int, hot: int) -> np.ndarray:
    """The bucket of each pair: by history, for the ``hot`` commonest histories by pair."""
    with np.errstate(over="ignore"):
        mixed = (history + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = np.where(history < np.uint64(hot), mixed + (word + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), mixed)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def pairs_of(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """history << 32 | word of every token; a text's first token has the end token as history."""
    history = np.empty(len(ids), np.uint64)
    history[1:] = ids[:-1]
    history[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = end
    return (history << np.uint64(32)) | ids


def chunks(docs: DataFrame, key: str, text: str, modulus: int) -> DataFrame:
    """(chunk, keys, held, sizes, tokens, words, trained): documents as local word ids.

    Word 0 is the end token, written as the empty word; ids are ordered by count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        class Vocabulary(dict):
            def __missing__(self, word: bytes) -> int:
                n = self[word] = len(self)
                return n

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 20
        kind = None

        def fresh() -> tuple:
            return Vocabulary({b"": 0}), array("i"), [], [], []

        words, tokens, keys, held, sizes = fresh()

        def row() -> pa.RecordBatch:
            local = np.frombuffer(tokens, np.int32)
            n = np.array(sizes, np.int64)
            learn = np.repeat(~np.array(held, bool), n)
            trained = np.bincount(local[learn], minlength=len(words))
            order = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
            order = np.concatenate(([0], order[order != 0]))
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            names = list(words)
            columns = [[number], [keys], [held], [sizes], [pack(place[local])], [[names[i] for i in order.tolist()]], [trained[order].tolist()]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk", "keys", "held", "sizes", "tokens", "words", "trained"])

        for batch in batches:
            kind = batch.column(0).type
            for k, h, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = (t.as_py() or b"").lower().split()
                tokens.extend(map(words.__getitem__, found))
                tokens.append(0)
                keys.append(k.as_py())
                held.append(h.as_py())
                sizes.append(len(found) + 1)
                if len(tokens) >= CHUNK:
                    yield row()
                    number += 1
                    words, tokens, keys, held, sizes = fresh()
        if keys:
            yield row()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key), modulus).alias("held"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"chunk long, keys array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, words array<binary>, trained array<long>")


def number_words(table: DataFrame, spark: SparkSession) -> tuple[DataFrame, Unigrams, int]:
    """(word, id) of the training words by falling count, their statistics and the end token's id."""
    each = table.select(F.explode(F.arrays_zip("words", "trained")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.trained").alias("n")).filter("n > 0")
    totals = each.groupBy("word").agg(F.sum("n").alias("n"))
    ranked = totals.repartitionByRange(shuffle_partitions(spark), F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word"))
    ranked = stored(ranked.withColumn("at", F.monotonically_increasing_id()), "katz-words")
    counts = {r["n"]: r["kinds"] for r in ranked.groupBy("n").agg(F.count(F.lit(1)).alias("kinds")).collect()}
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["rows"]) for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "part long, before long")
    numbered = ranked.withColumn("part", part).join(offsets, "part").select("word", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
    end = numbered.filter(F.octet_length("word") == 0).first()
    return numbered, Unigrams.of(counts), end["id"] if end else UNKNOWN


def globalise(table: DataFrame, numbered: DataFrame, spark: SparkSession) -> DataFrame:
    """The chunks with global word ids in place of local ones."""
    asked = table.select("chunk", F.posexplode("words").alias("local", "word"))
    told = asked.join(numbered, "word", "left").select("chunk", "local", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts = None, []

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([pack(ids)], pa.binary())], names=["chunk", "n", "ids"])

        for batch in batches:
            of, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(of)) + 1
            for c, part in zip(np.split(of, cuts), np.split(ids, cuts), strict=True):
                if not len(c):
                    continue
                if c[0] != chunk:
                    if parts:
                        yield row()
                    chunk, parts = int(c[0]), []
                parts.append(part)
        if parts:
            yield row()

    width = shuffle_partitions(spark)
    ids = told.repartition(width, "chunk").sortWithinPartitions("chunk", "local").select("chunk", "id").mapInArrow(gather, "chunk long, n int, ids binary")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for sizes, local, n, own in zip(batch.column("sizes"), batch.column("tokens"), batch.column("n"), batch.column("ids"), strict=True):
                [at] = unpack(local.as_py(), [int(np.asarray(sizes.values).sum())])
                [names] = unpack(own.as_py(), [n.as_py()])
                tokens.append(pack(names[at]))
            yield pa.record_batch([*(batch.column(c) for c in ("chunk", "keys", "held", "sizes")), pa.array(tokens, pa.binary())], names=["chunk", "keys", "held", "sizes", "tokens"])

    kind = table.schema["keys"].dataType.simpleString()
    met = table.drop("words", "trained").join(ids, "chunk")
    return met.mapInArrow(swap, f"chunk long, keys {kind}, held array<boolean>, sizes array<int>, tokens binary")


def open_chunk(sizes, held, tokens, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, distinct pairs, pair number of each token, training count of each pair) of one chunk."""
    n = np.asarray(sizes.values).astype(np.int64)
    [ids] = unpack(tokens.as_py(), [int(n.sum())])
    ids = ids.astype(np.uint64)
    pairs, inverse = np.unique(pairs_of(ids, n, end), return_inverse=True)
    learn = np.repeat(~np.array(held.as_py(), bool), n)
    return ids, n, pairs, inverse, np.bincount(inverse[learn], minlength=len(pairs))


def layout(pairs: np.ndarray, buckets: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, order, bucket): the pairs with a known history, in the order they are sent."""
    history = pairs >> np.uint64(32)
    asked = np.flatnonzero(history != np.uint64(UNKNOWN))
    bucket = deal(history[asked], pairs[asked] & np.uint64(UNKNOWN), buckets, hot)
    order = np.argsort(bucket, kind="stable")
    return asked[order], order, bucket[order]


def ask(table: DataFrame, end: int, buckets: int, hot: int) -> DataFrame:
    """(bucket, chunk, n, pairs): each chunk's distinct pairs and training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, held, tokens in zip(*(batch.column(c) for c in ("chunk", "sizes", "held", "tokens")), strict=True):
                _, _, pairs, _, counts = open_chunk(sizes, held, tokens, end)
                asked, _, bucket = layout(pairs, buckets, hot)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                firsts = np.concatenate(([0], cuts)) if len(bucket) else []
                names, lengths, blobs = [], [], []
                for part, at in zip(np.split(asked, cuts), firsts, strict=False):
                    history = (pairs[part] >> np.uint64(32)).astype(np.int64)
                    names.append(int(bucket[at]))
                    lengths.append(len(part))
                    blobs.append(pack(np.diff(history, prepend=0), pairs[part] & np.uint64(UNKNOWN), counts[part]))
                yield pa.record_batch([pa.array(names, pa.int32()), pa.array([chunk.as_py()] * len(names), pa.int64()), pa.array(lengths, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "n", "pairs"])

    return table.mapInArrow(run, "bucket int, chunk long, n int, pairs binary")


ANSWER = "kind string, bucket int, chunk long, n int, m int, blob binary, sums binary"


def answer(asked: DataFrame, words: Unigrams, buckets: int, hot: int) -> DataFrame:
    """The buckets' rows, told apart by ``kind``.

    model: the seen pairs and their counts.  reply: the counts of one chunk's pairs, with the sums of
    those of its histories that back off.  hot: sums over the bucket of a history that is spread
    over buckets.  counts: the bucket's counts of counts.
    """

    def settle(bucket: int, chunk: list[int], sizes: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        parts = []
        for n, blob in zip(sizes, blobs, strict=True):
            step, word, count = unpack(blob, [n, n, n])
            history = np.cumsum(step.astype(np.int64)).astype(np.uint64)
            parts.append(((history << np.uint64(32)) | word.astype(np.uint64), count))
        pairs, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([c for _, c in parts]).astype(np.float64), len(pairs)).astype(np.int64)
        history, word = pairs >> np.uint64(32), pairs & np.uint64(UNKNOWN)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(history)) + 1))
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(pairs)]))))
        names = history[starts]
        low = np.stack([np.bincount(group[counts == r], minlength=len(starts)) for r in range(1, TOP + 1)])
        below = np.bincount(group, np.where(counts > 0, words.chances(words.counts(word)), 0.0), len(starts))
        rows = []

        def sums(at: np.ndarray) -> bytes:
            import zstandard

            return zstandard.ZstdCompressor(level=1).compress(names[at].astype("<u8").tobytes() + low[:, at].astype("<i8").tobytes() + below[at].astype("<f8").tobytes())

        seen = counts > 0
        rows.append(("model", bucket, 0, int(seen.sum()), 0, pack(np.diff(history[seen].astype(np.int64), prepend=0), word[seen], counts[seen]), b""))
        heavy = np.flatnonzero(names < np.uint64(hot))
        if len(heavy):
            rows.append(("hot", bucket, 0, 0, len(heavy), b"", sums(heavy)))
        few = np.bincount(np.minimum(counts[seen], TOP + 2), minlength=TOP + 3)[1 : TOP + 2]
        rows.append(("counts", bucket, 0, 0, 0, few.astype("<i8").tobytes(), b""))
        bare = low.sum(axis=0) == 0
        at = 0
        for c, n in zip(chunk, sizes, strict=True):
            mine = inverse[at : at + n]
            at += n
            own = counts[mine]
            need = np.unique(group[mine][(own == 0) | bare[group[mine]]])
            need = need[names[need] >= np.uint64(hot)]
            rows.append(("reply", bucket, c, n, len(need), pack(own), sums(need)))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "chunk", "n", "m", "blob", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunk, sizes, blobs = None, [], [], []
        for batch in batches:
            for b, c, n, p in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != bucket:
                    if blobs:
                        yield settle(bucket, chunk, sizes, blobs)
                    bucket, chunk, sizes, blobs = b, [], [], []
                chunk.append(c)
                sizes.append(n)
                blobs.append(p)
        if blobs:
            yield settle(bucket, chunk, sizes, blobs)

    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.select("bucket", "chunk", "n", "pairs").mapInArrow(run, ANSWER)


def open_sums(blob: bytes, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(histories, numbers of pairs seen 1..TOP times, unigram mass of the words seen) of a sums blob."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=8 * m * (TOP + 2) + 1)
    names = np.frombuffer(raw, "<u8", m)
    low = np.frombuffer(raw, "<i8", TOP * m, 8 * m).reshape(TOP, m)
    return names, low, np.frombuffer(raw, "<f8", m, 8 * m * (TOP + 1))


def backoff(low: np.ndarray, below: np.ndarray, total: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, denominator) per history; a history without discounted pairs yields one part in c(h) + 1."""
    ranks = np.arange(1, TOP + 1)
    freed = (low * (ranks * (1 - discount[1 : TOP + 1]))[:, None]).sum(axis=0)
    bare = freed <= 0
    denominator = np.where(bare, total + 1, total)
    return np.where(bare, 1.0, freed) / denominator / np.maximum(1 - below, 1e-300), denominator


def chunk_scores(ids, sizes, pairs, inverse, counts, words: Unigrams, discount, names, alpha, denominator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probability, base log10 probability, known tokens) of each document of one chunk.

    ``counts`` belongs to ``pairs``; ``names`` are sorted histories with their alpha and denominator.
    """
    history, word = pairs >> np.uint64(32), pairs & np.uint64(UNKNOWN)
    below = words.chances(words.counts(word))
    weight, total = np.ones(len(pairs)), words.counts(history).astype(np.float64)
    if len(names):
        at = np.minimum(np.searchsorted(names, history), len(names) - 1)
        met = names[at] == history
        weight[met], total[met] = alpha[at[met]], denominator[at[met]]
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = np.where(counts > 0, discount[np.minimum(counts, TOP + 1)] * counts / total, weight * below)
    logs = np.log10(chance)[inverse]
    own = words.counts(ids)
    base = np.log10((own + 1) / (words.total + words.size + 1))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.add.reduceat(logs, starts), np.add.reduceat(base, starts), np.add.reduceat((own > 0).astype(np.int64), starts)


@dataclass
class Model:
    """A trained model: its word statistics and, in the folder ``path``, the pair tables by kind."""

    path: str
    words: Unigrams
    end: int
    buckets: int
    hot: int
    discount: np.ndarray


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7) -> tuple[Model, DataFrame]:
    """The model of the documents outside the held-out fold, and all documents as chunks."""
    spark = docs.sparkSession
    local = stored(chunks(docs, key, text, modulus), "katz-chunks", compression="zstd")
    numbered, words, end = number_words(local, spark)
    table = stored(globalise(local, numbered, spark), "katz-tokens", compression="none")
    discard(local)
    buckets = shuffle_partitions(spark)
    hot = int(np.searchsorted(-words.values, -max(1, words.total // buckets), side="right"))
    hot = int(words.ends[hot - 1]) if hot else 0
    path = shared_dir(spark, "katz-pairs")
    answer(ask(table, end, buckets, hot), words, buckets, hot).write.partitionBy("kind").option("compression", "none").parquet(path)
    found: dict[int, int] = {}
    rows = read_kind(spark, path, "counts").mapInArrow(sum_counts, "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()
    for row in rows:
        found[row["r"]] = row["n"]
    return Model(path, words, end, buckets, hot, discounts(found)), table


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = T._parse_datatype_string(ANSWER)
    return spark.read.schema(schema).parquet(path).filter(F.col("kind") == kind)


def sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TOP + 1, np.int64)
    for batch in batches:
        for blob in batch.column("blob"):
            total += np.frombuffer(blob.as_py(), "<i8")
    yield pa.record_batch([pa.array(range(1, TOP + 2), pa.int32()), pa.array(total)], names=["r", "n"])


def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m, blob in zip(batch.column("m"), batch.column("sums"), strict=True):
            names, low, below = open_sums(blob.as_py(), m.as_py())
            yield pa.record_batch([pa.array(names.astype(np.int64)), *(pa.array(x) for x in low), pa.array(below)], names=["h", *(f"n{r}" for r in range(1, TOP + 1)), "below"])


def score(model: Model, table: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = table.sparkSession
    words, end, buckets, hot, discount = model.words, model.end, model.buckets, model.hot, model.discount
    schema = "h long, " + ", ".join(f"n{r} long" for r in range(1, TOP + 1)) + ", below double"
    spread = read_kind(spark, model.path, "hot").mapInArrow(hot_sums, schema).groupBy("h").agg(*(F.sum(f"n{r}").alias(f"n{r}") for r in range(1, TOP + 1)), F.sum("below").alias("below"))
    rows = sorted(spread.collect(), key=lambda r: r["h"])  # at most one for each bucket
    hot_names = np.array([r["h"] for r in rows], np.uint64)
    hot_low = np.array([[r[f"n{k}"] for r in rows] for k in range(1, TOP + 1)], np.int64).reshape(TOP, len(rows))
    hot_below = np.array([r["below"] for r in rows], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, held, sizes, tokens, replies in zip(*(batch.column(c) for c in ("keys", "held", "sizes", "tokens", "replies")), strict=True):
                ids, n, pairs, inverse, _ = open_chunk(sizes, held, tokens, end)
                asked, _, _ = layout(pairs, buckets, hot)
                told = sorted((r["bucket"], r["n"], r["m"], r["blob"], r["sums"]) for r in replies.as_py() or [])
                counts = np.zeros(len(pairs), np.int64)
                if told:
                    counts[asked] = np.concatenate([unpack(blob, [size])[0] for _, size, _, blob, _ in told])
                parts = [open_sums(blob, m) for _, _, m, _, blob in told if m] + [(hot_names, hot_low, hot_below)]
                names, low, below = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1), np.concatenate([p[2] for p in parts])
                order = np.argsort(names, kind="stable")
                names, low, below = names[order], low[:, order], below[order]
                alpha, denominator = backoff(low, below, words.counts(names).astype(np.float64), discount)
                score, base, known = chunk_scores(ids, n, pairs, inverse, counts, words, discount, names, alpha, denominator)
                yield pa.record_batch([keys.values, held.values, pa.array(n), pa.array(known), pa.array(np.full(len(n), words.total)), pa.array(base), pa.array(score)], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = table.schema["keys"].dataType.elementType.simpleString()
    replies = read_kind(spark, model.path, "reply").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "m", "blob", "sums")).alias("replies"))
    met = table.join(replies, "chunk", "left")
    out = met.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7) -> DataFrame:
    """Train on the documents outside fold 2 of ``modulus`` and score all of them.

    Null text counts as empty (its one token is the end); rows with a null key are trained on;
    repeated rows count and are scored each; extra columns are ignored; an empty table gives an
    empty result.  With no training rows every token is unknown and has probability 1.
    """
    model, table = train(docs, key, text, modulus)
    return score(model, table, key)
