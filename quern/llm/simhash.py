"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint keeps, per bit, the majority of the 64-bit hashes of a text's word shingles.
Fingerprints within ``radius`` bits of each other are linked; the classes are the connected
components of these links.

The tables follow the covering construction: every bit position ``i`` has a non-zero vector
``m(i)`` of ``radius + 1`` bits, and every non-zero vector ``v`` gives a mask that keeps the
positions with ``<m(i), v> = 1``.  The vectors of any ``radius`` differing positions span at
most ``radius`` dimensions, so some ``v`` is orthogonal to all of them: the mask of that ``v``
keeps none of the differing bits and the pair meets in that table.  No pair is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, stored
from quern.llm.components import components
from quern.llm.groups import band_keys, filter_bits, filtered, linked, met, minima, mixed, odd_factors

BITS = 64
#: Runs beyond this many fingerprints are first cut by blocks of their open bits.
WIDE = 4096


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text (the whole sequence of a shorter one; none without words)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(whole[s:e], seed) for s, e in spans), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the A-Z-lower-cased words of one text (0 without words)."""
    hashes = shingle_hashes(text or "", width, seed)
    return majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): signed 64-bit fingerprint of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks; positions take the non-zero vectors in turn."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _forest(run: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges of a spanning forest of one run's link graph: each value found is compared on."""
    left, right, rest = [], [], run
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at, np.uint64))
                right.append(found)
                todo.extend(found)
                rest = rest[~near]
    return left, right


def _links(run: np.ndarray, radius: int) -> tuple[list, list]:
    """As _forest; a wide run is first cut exactly by pigeonhole blocks of the bits it varies in."""
    if len(run) <= WIDE:
        return _forest(run, radius)
    # what lies around the commonest bits is absorbed by one comparison
    ones = np.unpackbits(run.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(axis=0)
    open_bits = np.flatnonzero((ones > 0) & (ones < 1))
    left, right = [], []
    for block in np.array_split(open_bits, radius + 1):
        mask = np.uint64(sum(1 << int(i) for i in block))
        order = np.argsort(run & mask, kind="stable")
        cut = run[order]
        edges = np.flatnonzero(np.diff(cut & mask)) + 1
        for part in np.split(cut, edges):
            if len(part) > 1:
                a, b = _forest(part, radius)
                left += a
                right += b
    return left, right


def _linker(radius: int):
    def pack(left: list, right: list) -> pa.RecordBatch:
        a = np.concatenate(left) if left else np.empty(0, np.uint64)
        b = np.concatenate(right) if right else np.empty(0, np.uint64)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def settle(table, masked, prints) -> pa.RecordBatch:
        """Links of complete runs."""
        same = (table[1:] == table[:-1]) & (masked[1:] == masked[:-1])
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        sizes = np.diff(np.concatenate((starts, [len(table)])))
        two = starts[sizes == 2]
        close = np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius
        left, right = [prints[two][close]], [prints[two + 1][close]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = _links(prints[at : at + n], radius)
            left += a
            right += b
        return pack(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the run that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(np.asarray(batch.column(k)) for k in range(3)))
            table, masked = held[-1][0], held[-1][1]
            begun = held[0]
            if len(held) > 1 and table[-1] == begun[0][-1] and masked[-1] == begun[1][-1] and table[0] == table[-1] and masked[0] == masked[-1]:
                continue  # the whole batch belongs to the open run
            table, masked, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            open_from = int(np.flatnonzero((table != table[-1]) | (masked != masked[-1]))[-1] + 1) if ((table != table[-1]) | (masked != masked[-1])).any() else 0
            if open_from:
                yield settle(table[:open_from], masked[:open_from], prints[:open_from].view(np.uint64))
            held = [(table[open_from:], masked[open_from:], prints[open_from:])]
        if held:
            table, masked, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            yield settle(table, masked, prints.view(np.uint64))

    return run


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct ``fp`` within ``radius``.

    ``prints`` must hold each fingerprint once.  Every fingerprint goes to one bucket per mask;
    buckets are read in sorted order, and of each only the edges of a spanning forest leave.
    """
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks)]))
    rows = prints.select("fp", tables.alias("x")).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp")
    dealt = rows.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    return dealt.mapInArrow(_linker(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(key, fp, component_id) for every row of ``docs``; component_id is the least key reachable.

    Null text counts as empty; texts without words have fingerprint 0 and link like others.
    Repeated keys give repeated rows; a null key is returned but names no class.  Other columns
    are ignored.  An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, key, text, width), "prints")
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    found = components(near_links(reps.select("fp"), radius))
    rooted = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(F.col("id").alias(key), "fp", "component_id")


#: Bands of minima and minima in each, for pairs of a similarity threshold.
BANDS, WIDTH = 24, 6
FACTORS = odd_factors(BANDS * WIDTH, 2)
#: Bits of the filters over keys, as a power of two.
FILTER = 23
#: How far below the threshold the share of equal minima may lie: 4.5 standard errors at 0.8.
SLACK = 0.15


def set_sketches(docs: DataFrame, key: str, text: str, width: int, radius: int) -> DataFrame:
    """(id, d0, d1, places, sketch): digest of each row's set of shingles, where it may meet others, low bytes of its minima.

    A set meets others in the covering tables of its fingerprint and in its bands.  Sets that
    came before in the same batch have no places; a text without words is an empty set.
    """
    masks = np.array(covering_masks(radius), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py() or "", width)) for t in part.column(1)]
                sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
                digests = np.array([divmod(xxhash.xxh128_intdigest(x.tobytes()), 1 << 64) for x in sets], np.uint64).reshape(-1, 2)
                sizes = np.array([len(x) for x in sets])
                least = minima(np.concatenate(sets), np.cumsum(sizes) - sizes, FACTORS)
                prints = np.array([majority(x) for x in sets], np.uint64)
                with np.errstate(over="ignore"):
                    tables = mixed((prints[:, None] & masks) * np.uint64(0x9E3779B97F4A7C15) + np.arange(7, 7 + len(masks), dtype=np.uint64))
                places = np.concatenate((band_keys(least, WIDTH, 3000), tables), axis=1)
                _, first = np.unique(digests, axis=0, return_index=True)
                fresh = np.zeros(len(sets), bool)
                fresh[first] = True
                ends = pa.array(np.concatenate(([0], np.cumsum(fresh * places.shape[1]))), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(places[fresh].ravel().view(np.int64)))
                sketch = pa.array([x.tobytes() if new else None for x, new in zip(least.astype(np.uint8), fresh, strict=True)], pa.binary())
                yield pa.record_batch([part.column(0), *(pa.array(np.ascontiguousarray(digests[:, k]).view(np.int64)) for k in range(2)), lists, sketch], names=["id", "d0", "d1", "places", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, d0 long, d1 long, places array<long>, sketch binary")


def like_sketches(least: float):
    """Preparation and neighbours of sketches: a share of equal bytes of ``least`` or more."""

    def prepare(payload: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)

    def near(items: np.ndarray, at: int, rest: np.ndarray) -> np.ndarray:
        return rest[(items[rest] == items[at]).mean(axis=1) >= least]

    return prepare, near


def like_sets(width: int, similarity: float):
    """Preparation and neighbours of texts: a Jaccard similarity of their shingle sets of ``similarity`` or more."""

    def prepare(payload: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = [np.unique(shingle_hashes(t, width)) for t in payload]
        sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
        sizes = np.array([len(x) for x in sets])
        return sets, sizes, minima(np.concatenate(sets), np.cumsum(sizes) - sizes, FACTORS)

    def near(items: tuple[list[np.ndarray], np.ndarray, np.ndarray], at: int, rest: np.ndarray) -> np.ndarray:
        sets, sizes, least = items
        rest = rest[np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at]) - 1e-9]
        rest = rest[(least[rest] == least[at]).mean(axis=1) >= similarity - SLACK]
        found = []
        for k in rest.tolist():
            place = np.searchsorted(sets[k], sets[at])
            place[place == sizes[k]] = 0
            both = np.count_nonzero(sets[k][place] == sets[at])
            if both >= similarity * (sizes[k] + sizes[at] - both) - 1e-9:
                found.append(k)
        return np.array(found, np.int64)

    return prepare, near


def similar_sets(docs: DataFrame, key: str, text: str, width: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(rows (id, d0, d1), classes (d0, d1, root)): the shingle set of every row, and the class of the sets that have similar ones."""
    rows = stored(set_sketches(docs, key, text, width, radius), "sets")
    nodes = rows.filter("sketch is not null").groupBy("d0", "d1").agg(F.min("id").alias("id"), F.first("sketch").alias("payload"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "set-nodes")
    asked = met(rows.select(F.explode("places").alias("bucket"), F.col("d0").alias("h")))
    met_sets = stored(asked.join(nodes, F.col("h") == F.col("d0")).select("root", F.col("node").alias("h"), "payload"), "met")
    # what shares many minima is read together, each text once
    close = components(linked(met_sets, *like_sketches(similarity - SLACK)))
    chosen = stored(nodes.join(close, "node").select("root", "node", "d0", "d1", "id"), "close")
    wanted = chosen.select(F.col("id").alias("_id"), "root", "node", "d0", "d1")
    bits = filter_bits(chosen.select(F.xxhash64("id").alias("h")), FILTER)
    texts = filtered(docs.select(F.col(key).alias("_key"), F.col(text).alias("payload")), "_key", bits, True).join(wanted, F.col("_key") == F.col("_id"))
    members = stored(texts.select("root", F.col("node").alias("h"), F.coalesce("payload", F.lit("")).alias("payload")).dropDuplicates(["root", "h"]), "members")
    found = components(linked(members, *like_sets(width, similarity)))
    classes = stored(chosen.select("node", "d0", "d1").join(found, "node").select("d0", "d1", F.col("root")), "set-classes")
    for table in (met_sets, members, chosen):
        discard(table)
    return rows.select("id", "d0", "d1"), classes


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """One document, that with the least key, of each class of similar documents; all its columns.

    Classes are the components of links between documents whose sets of ``width``-word shingles
    have a Jaccard similarity of ``similarity`` or more, decided on the exact sets.  Documents meet in the covering
    tables of their fingerprints, where every pair within ``radius`` bits does, and in bands of
    minima: a similarity of 0.8 lies about ten of 64 bits apart, beyond what covering tables can
    promise, and meets in a band with a probability of 0.999.

    Texts without words (null ones too) are one class.  Equal texts are one set, whatever their number.
    Rows that repeat a key stay or go together; rows with a null key stay.  Texts of any length
    count whole; extra columns are kept; an empty table gives an empty result.
    """
    named = docs.filter(F.col(key).isNotNull())
    rows, classes = similar_sets(named, key, text, width, similarity, radius)
    sets = rows.groupBy("d0", "d1").agg(F.min("id").alias("id"))
    roots = sets.join(classes, ["d0", "d1"], "left").select("id", F.coalesce(F.col("root"), -1 - F.monotonically_increasing_id()).alias("root"))
    kept = roots.groupBy("root").agg(F.min("id").alias("_kept")).select("_kept").distinct()
    gone = stored(rows.select(F.col("id").alias("_gone")).distinct().join(kept, F.col("_gone") == F.col("_kept"), "left_anti"), "gone")
    bits = filter_bits(gone.select(F.xxhash64("_gone").alias("h")), FILTER)
    # only rows that the filter takes for dropped ones travel
    doubtful = filtered(docs, key, bits, True)
    return filtered(docs, key, bits, False).unionByName(doubtful.join(gone, doubtful[key] == gone["_gone"], "left_anti"))
