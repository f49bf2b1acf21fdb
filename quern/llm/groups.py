"""Candidate groups and the links inside them, for groups of any size.

``met`` turns (bucket, h) rows into sets of items that share buckets.  ``linked`` compares
the items of each set by a given test and returns links whose components are those of all pairs
that pass it.  No set is read whole by one task beyond a fixed size: larger ones are dealt
into parts; each part is settled alone, the leader of the largest class is compared with all
others, and what is then outside that class is compared with every part in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored

#: Members and payload bytes of a part, at most about.
MOST, MOST_BYTES = 1024, 16 << 20
#: Upper bits of a bucket that name its part, pairs in a parcel, and pairs that are put in order at once.
PART_BITS, PARCEL, AT_ONCE = 12, 512, 1 << 20
#: Sets whose members are compared together, and their characters.
SETS, SET_CHARS = 4096, 4 << 20
#: Where the filter takes its bits from.
SHIFTS = (0, 20, 40)


#: Characters of texts that are worked on together.
PIECE = 1 << 18


def pieces(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a column in runs of about PIECE characters, with the place of the first."""
    held, size, at = [], 0, 0
    for k, t in enumerate(column):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > PIECE:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def filter_bits(rows: DataFrame, power: int) -> np.ndarray:
    """A Bloom filter of 2^power bits (20 to 24) over ``h``, put together on the executors; its size is fixed."""
    mask = (1 << power) - 1
    at = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(mask)) for s in SHIFTS])).alias("at")
    words = rows.select("h").distinct().select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes that are in the filter (a few others pass, none is lost)."""
    found, mask = np.ones(len(h), bool), np.uint64(len(bits) * 64 - 1)
    for s in SHIFTS:
        at = h >> np.uint64(s) & mask
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return np.flatnonzero(found)


def filtered(rows: DataFrame, key: str, bits: np.ndarray, inside: bool) -> DataFrame:
    """The rows whose xxhash64 of ``key`` is in the filter, or those for which it is not; no shuffle."""
    at = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            found[passing(np.asarray(batch.column(at)).view(np.uint64), bits)] = True
            yield batch.select(range(at)).filter(pa.array(found == inside))

    return rows.withColumn("_filter_key", F.xxhash64(F.col(key))).mapInArrow(run, rows.schema)


def minima(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Per run of 64-bit hashes (from ``starts``) and factor the least 32-bit product: one row a run."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(factors)), np.uint32)
    for k, factor in enumerate(factors):
        out[:, k] = np.minimum.reduceat(low * factor, starts)
    return out


def odd_factors(n: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(1, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return values ^ (values >> np.uint64(32))


def band_keys(least: np.ndarray, width: int, name: int) -> np.ndarray:
    """One 64-bit key for each ``width`` neighbouring minima, told apart by ``name`` and place."""
    bands = least.shape[1] // width
    out = np.empty((len(least), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            joined = np.full(len(least), name + band, np.uint64)
            for column in least[:, band * width : (band + 1) * width].T:
                joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + column)
            out[:, band] = joined
    return out


def met(places: DataFrame) -> DataFrame:
    """(root, h): what shares a bucket of (bucket, h), under the bucket's least ``h``; each (root, h) once.

    Two items of one bucket share its root, so no pair is lost; buckets with one item have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root, alone = None, 0, True  # the bucket that may go on, its least item, whether that is its only one
        for batch in batches:
            bucket, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(h):
                continue
            new = np.append(True, bucket[1:] != bucket[:-1])
            goes_on = last is not None and bucket[0] == last
            starts = np.flatnonzero(new)
            least = h[starts]
            if goes_on:
                least[0] = root
            sizes = np.diff(np.append(starts, len(h)))
            roots = np.repeat(least, sizes)
            other = h != roots
            several = np.logical_or.reduceat(other, starts)
            a, b = [roots[other], least[several]], [h[other], least[several]]
            if goes_on and several[0] and not alone:  # its root was told before
                a[1], b[1] = a[1][1:], b[1][1:]
            alone = not several[-1] and (len(starts) > 1 or not goes_on or alone)
            last, root = bucket[-1], least[-1]
            pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["root", "h"])

    return places.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(run, "root long, h long").distinct()


def parcels(buckets: np.ndarray, h: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(part, parcel) of pairs of bucket and ``h``: up to PARCEL pairs of one part, as numbers of eight bytes."""
    part = (buckets >> np.uint64(64 - PART_BITS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part, n = part[order], len(order)
    new = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:n])
    starts = np.flatnonzero((np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))) % PARCEL == 0)
    data = np.stack((buckets, h.view(np.uint64)), axis=1)[order].astype("<u8", copy=False)
    offsets = np.append(starts, n).astype(np.int32) * np.int32(16)
    return pa.array(part[starts].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def met_parcels(rows: DataFrame) -> DataFrame:
    """``met`` of (part, parcel) rows as ``parcels`` makes them, with the same rows.

    A worker holds the pairs of one part, or of several small ones; those of a part with more than
    AT_ONCE pairs are put in order in slices of whole buckets.
    """

    def shared(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)
        slices = 1 << (len(data) // AT_ONCE).bit_length() if len(data) >= 2 * AT_ONCE else 1
        for k in range(slices):
            some = data if slices == 1 else data[(data[:, 0] >> np.uint64(8)) & np.uint64(slices - 1) == k]
            bucket = np.ascontiguousarray(some[:, 0])
            order = np.argsort(bucket)
            bucket = bucket[order]
            same = bucket[1:] == bucket[:-1]
            inside = np.append(same, False) | np.append(False, same)  # buckets with one pair have no rows
            bucket, h = bucket[inside], some[order[inside], 1].view(np.int64)
            if not len(h):
                continue
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            least = np.minimum.reduceat(h, starts)
            roots = np.repeat(least, np.diff(np.append(starts, len(h))))
            other = h != roots
            several = least[np.logical_or.reduceat(other, starts)]
            a, b = np.append(roots[other], several), np.append(h[other], several)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            yield pa.record_batch([pa.array(a[once]), pa.array(b[once])], names=["root", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            for part, parcel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != last and size >= 16 * AT_ONCE:
                    yield from shared(held)
                    held, size = [], 0
                last = part
                held.append(parcel)
                size += len(parcel)
        if held:
            yield from shared(held)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "root long, h long").distinct()


#: What compares the members of one part: prepared payloads, a member, others to find its neighbours among.
Near = Callable[[object, int, np.ndarray], np.ndarray]


def settled(items: object, near: Near, n: int) -> np.ndarray:
    """The first member of each member's class; each member found is compared on, and none twice."""
    seed, rest = np.arange(n), np.arange(n)
    while len(rest) > 1:
        first, todo, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while todo and len(rest):
            found = near(items, todo.pop(), rest)
            if len(found):
                seed[found] = first
                rest = rest[~np.isin(rest, found)]
                todo += found.tolist()
    return seed


def by_run(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list]]:
    """Columns of the rows that agree in the first ``width`` columns, in the order they come."""
    name, held = None, None
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held is None or row[:width] != name:
                if held is not None:
                    yield held
                name, held = row[:width], [[] for _ in row]
            for column, value in zip(held, row, strict=True):
                column.append(value)
    if held is not None:
        yield held


def linked(members: DataFrame, prepare: Callable[[list], object], near: Near, classes: Callable[[object, int], np.ndarray] | None = None, kinds_near: Callable[[object, int, np.ndarray, np.ndarray], np.ndarray] | None = None, most: int = MOST, most_bytes: int = MOST_BYTES, many: Callable[[list[list]], list[np.ndarray]] | None = None) -> DataFrame:
    """(a, b): links of members (root, h, payload) that pass the test, enough for its components in each root.

    ``members`` must be cheap to read twice (a stored table) and hold each (root, h) once.
    ``classes`` gives the first member of each class of a part where there is a better way than
    ``settled``; it must have compared all pairs of different classes.  ``kinds_near`` is told
    the kinds of all and finds at least one neighbour of each kind that has any; ``most`` and
    ``most_bytes`` bound a part, and so the comparisons of one task, which are quadratic in it.
    ``many`` gives what ``classes`` does for the payloads of several parts at once.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("m"))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(most)), F.ceil(F.col("m") / F.lit(most_bytes))).cast("int")
    large = size.select(F.col("root").alias("_root"), parts.alias("parts")).filter("parts > 1")
    dealt = members.join(large, members["root"] == large["_root"], "left").select("root", F.coalesce(F.pmod(F.xxhash64("h"), F.col("parts")), F.lit(0)).cast("int").alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), "h", "payload")

    def seeds(sets: list[list[list]]) -> list[np.ndarray]:
        if many:
            return many([x[4] for x in sets])
        return [(classes(prepare(x[4]), len(x[3])) if classes else settled(prepare(x[4]), near, len(x[3]))) for x in sets]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[list]]]:
        held, size = [], 0
        for one in by_run(batches, 2):
            held.append(one)
            size += sum(map(len, one[4])) if many else 0
            if not many or len(held) >= SETS or size >= SET_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (root, part, parts, h, _), seed in ((x, y) for sets in together(batches) for x, y in zip(sets, seeds(sets), strict=True)):
            told = np.arange(len(h)) if parts[0] > 1 else np.flatnonzero(seed != np.arange(len(h)))
            names = np.array(h, np.int64)
            yield pa.record_batch([pa.array(np.array(x)[told], t) for x, t in ((root, pa.int64()), (part, pa.int32()), (parts, pa.int32()))] + [pa.array(names[told]), pa.array(names[seed[told]])], names=["root", "part", "parts", "h", "seed"])

    rows = dealt.repartition("root", "part").sortWithinPartitions("root", "part", "h")
    first = stored(rows.mapInArrow(alone, "root long, part int, parts int, h long, seed long"), "links")
    links = first.filter("h != seed").select(F.col("h").alias("a"), F.col("seed").alias("b"))
    wide = first.filter("parts > 1")
    if wide.isEmpty():
        return links

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, part, _, asks, h, kind, own, payload in by_run(batches, 3):
            n = asks.index(True) if True in asks else len(asks)
            items, a, b, kinds = prepare(payload), [], [], np.array(kind, np.int64)
            for at in range(n, len(h)):
                # two that both ask meet once, in the part of less number
                others = np.flatnonzero((kinds[:n] != kinds[at]) & ((kinds[:n] == -1) | (own[at] > part[0])))
                found = kinds_near(items, at, others, kinds) if kinds_near else near(items, at, others)
                for other in {kinds[k]: k for k in found.tolist()}.values():
                    a.append(h[at])
                    b.append(h[other])
            yield pa.record_batch([pa.array([root[0]] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["root", "a", "b"])

    def crossed(told: DataFrame, asking: DataFrame) -> DataFrame:
        """Links between classes: every asking member against the members of its set that are of another class and
        not of its own part, where all were compared; a leader's ``own`` is beyond all parts."""
        total = told.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        asked = asking.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.max("parts").alias("p"))
        blocks = asked.join(total, "root").select("root", F.ceil(F.col("p") * F.col("m") / F.col("n")).cast("int").alias("blocks"))
        texts = members.withColumnRenamed("root", "_root").withColumnRenamed("h", "_h")
        same = (F.col("root") == F.col("_root")) & (F.col("h") == F.col("_h"))
        spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
        held = told.join(blocks, "root").join(texts, same).select("root", "part", spread("blocks", "block"), F.lit(False).alias("asks"), "h", "kind", F.lit(0).alias("own"), "payload")
        block = F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).cast("int").alias("block")
        sent = asking.join(blocks, "root").join(texts, same).select("root", spread("parts", "part"), block, F.lit(True).alias("asks"), "h", "kind", "own", "payload")
        rows = held.union(sent.filter("own != part")).repartition("root", "part", "block").sortWithinPartitions("root", "part", "block", "asks", "h")
        return rows.mapInArrow(across, "root long, a long, b long")

    # the leader of the largest class against all of its set; the classes it meets are one with it
    told = wide.select("root", "part", "parts", "h", F.col("seed").alias("kind"))
    classes = told.groupBy("root", "parts", "kind").agg(F.count(F.lit(1)).alias("n"))
    leaders = stored(classes.groupBy("root", "parts").agg(F.max(F.struct("n", "kind"))["kind"].alias("h")).withColumn("kind", F.col("h")).withColumn("own", F.col("parts")), "leaders")
    again = stored(crossed(told, leaders), "links")
    met_kinds = again.join(told, (again["root"] == told["root"]) & (again["b"] == told["h"])).select(told["root"].alias("_root"), F.col("kind").alias("_kind"))
    main = met_kinds.union(leaders.select("root", "h")).distinct()
    told = told.join(main, (F.col("root") == F.col("_root")) & (F.col("kind") == F.col("_kind")), "left")
    told = told.select("root", "part", "parts", "h", F.when(F.col("_kind").isNull(), F.col("kind")).alias("kind"))
    # what is left against all of other classes; the largest class goes by a name that no member has
    told = stored(told.fillna(-1, ["kind"]), "classes")
    last = stored(crossed(told, told.filter("kind != -1").select("root", "parts", "h", "kind", F.col("part").alias("own"))), "links")
    return links.unionByName(again.select("a", "b")).unionByName(last.select("a", "b"))
