"""Fuzzy line de-duplication: SimHash and minima, shared blocks, edit similarity, connected groups.

Lines are normalised (lower case, digits as 0, white space collapsed); equal normalised lines are
one node, named by 128 bits of their digest.  The features of a line are its
words of four bytes and more; lines with few such words, and those without blanks, have grams of
six bytes.  Lines meet

* by pigeonhole: the 64-bit SimHash of the features is cut into two blocks, and two fingerprints
  within one bit agree on a whole block;
* by bands of minima over the features, since most lines of edit similarity 0.8 are
  further apart than a block scheme of 64 bits can promise;
* lines of at most 14 characters by what up to two deletions leave of them, which every
  such pair of edit similarity 0.8 shares.

Edit similarity alone links two lines that meet.  Of each connected group of lines the first
occurrence in (document, line) order stays.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, stored
from quern.llm.components import components
from quern.llm.groups import AT_ONCE, band_keys, filter_bits, linked, met_parcels, minima, mixed, odd_factors, parcels, passing, pieces

#: Digits to 0, white space but line ends to blanks.
NORMAL = bytes.maketrans(b"123456789\t\r\x0b\x0c", b"000000000    ")
#: Bands of minima, and minima in each over words and over grams; bytes of a gram; bytes of a word that counts.
BANDS, WORD_WIDTH, GRAM_WIDTH, GRAM, LONG_WORD = 12, 5, 4, 6, 4
FACTORS = odd_factors(BANDS * WORD_WIDTH, 1)
#: Lines with fewer counting words than the second have grams; those with as many as the first have words.
WORDS_FROM, GRAMS_BELOW = 8, 12
#: Lines of at most so many characters also meet by deletions.
SHORT = 14
#: Lines that are compared with one at once, and from how many on that is done without other pairs.
LANES, ALONE = 256, 48
#: Bits of the columns of pairs that are compared at once, and columns whose matches are found at once.
COLUMN_BITS, COLUMNS = 1 << 16, 16
#: Bytes of lines in a part of a large set: what one task compares is quadratic in them.
PART_BYTES = 128 << 10
#: The two blocks of a SimHash.
BLOCKS = np.array([0xFFFFFFFF, 0xFFFFFFFF << 32], np.uint64)


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - edit distance / longer length is at least ``least``."""
    longer = max(len(a), len(b))
    if a == b or not longer:
        return True
    allowed = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return False
    return aligned(a.split(" "), b.split(" "), allowed) <= allowed or distance(a, b, allowed) <= allowed


#: How far two word lists may be apart where they agree again, the nearest first.
STEPS = tuple((i, ahead - i) for ahead in range(1, 4) for i in range(ahead + 1))


def aligned(a: list[str], b: list[str], most: float = float("inf")) -> float:
    """An upper bound of the edit distance: words are matched in order, what lies between is replaced.

    Over ``most`` it may stop early.
    """
    at, to, cost, n, m = 0, 0, 0, len(a), len(b)
    while at < n and to < m:
        if a[at] == b[to]:
            at, to = at + 1, to + 1
            continue
        for down, along in STEPS:  # the next words that agree, a few ahead at most
            if at + down < n and to + along < m and a[at + down] == b[to + along]:
                break
        else:
            down = along = 1
        gone, come = sum(map(len, a[at : at + down])) + down, sum(map(len, b[to : to + along])) + along
        cost += gone if gone > come else come
        if cost > most:
            return cost
        at, to = at + down, to + along
    return cost + max(sum(map(len, a[at:])) + n - at, sum(map(len, b[to:])) + m - to)


def distance(a: str, b: str, allowed: int) -> int:
    """Edit distance by bit-parallel columns in one long integer; over ``allowed`` it may stop early."""
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score, left = full, 0, len(a), len(b)
    for c in b:
        left -= 1
        match = where.get(c, 0)
        zero = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(zero | plus) & full
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score - left > allowed:
            return score - left
        up = (up << 1 | 1) & full
        down = (down << 1) & full
        plus = down | ~(zero | up) & full
        minus = up & zero
    return score


def close(text: str, others: list[str], least: float) -> np.ndarray:
    """``similar`` of one line to each of others: the bit-parallel columns of all lie in one long integer."""
    sizes = np.array([len(x) for x in others])
    width = int(sizes.max()) // 8 * 8 + 8  # a free bit above each line takes the carry
    inside = np.arange(width) < sizes[:, None]
    codes = np.zeros(inside.shape, np.uint32)
    codes[inside] = np.frombuffer("".join(others).encode("utf-32-le"), "<u4")

    def mask(places: np.ndarray) -> int:
        return int.from_bytes(np.packbits(places, axis=1, bitorder="little").tobytes(), "little")

    where = {c: mask((codes == ord(c)) & inside) for c in set(text)}
    full, first = mask(inside), mask(np.broadcast_to(np.arange(width) == 0, inside.shape))
    plus, minus = full, 0
    for c in text:
        match = where[c]
        zero = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | full & ~(zero | plus)
        down = plus & zero
        up = (up << 1 | first) & full
        plus = (down << 1) & full | full & ~(zero | up)
        minus = up & zero
    rose, fell = (np.bitwise_count(np.frombuffer(x.to_bytes(inside.size // 8, "little"), np.uint8)).reshape(len(others), -1).sum(axis=1, dtype=np.int64) for x in (plus, minus))
    return len(text) + rose - fell <= ((1 - least) * np.maximum(sizes, len(text)) + 1e-9).astype(np.int64)


def agree(a: str, b: str) -> int:
    """How many characters two lines have in common from the start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distance of each pair: the bit-parallel columns of pairs of like length lie in one long integer."""
    out = np.zeros(len(pairs), np.int64)
    todo = []
    for k, (a, b) in enumerate(pairs):
        start = agree(a, b)
        a, b = a[start:], b[start:]
        if end := agree(a[::-1], b[::-1]):
            a, b = a[:-end], b[:-end]
        if len(a) > len(b):
            a, b = b, a
        if a:
            todo.append((len(b), len(a), k, a, b))
        else:
            out[k] = len(b)
    todo.sort(key=lambda x: x[:3], reverse=True)
    while todo:
        width, n = 0, 0
        for size, short, *_ in todo:  # the longest first
            if n and (max(width, short // 8 * 8 + 8) * (n + 1) > COLUMN_BITS or size < 0.7 * todo[0][0]):
                break
            width, n = max(width, short // 8 * 8 + 8), n + 1  # a free bit above each line takes the carry
        some, todo = todo[:n], todo[n:]
        out[[x[2] for x in some]] = columns([x[3] for x in some], [x[4] for x in some], width)
    return out


def columns(down: list[str], along: list[str], width: int) -> np.ndarray:
    """Edit distances of lines shorter than ``width`` to others, of which none is longer than the one before."""
    n, sizes, steps = len(down), np.array([len(x) for x in down]), np.array([len(x) for x in along])
    codes = np.frombuffer("".join(down + along).encode("utf-32-le", "surrogatepass"), "<u4")
    names, codes = np.unique(codes, return_inverse=True)
    codes = codes.astype(np.uint8 if len(names) < 254 else np.uint32) + 2
    inside, read = np.arange(width) < sizes[:, None], np.arange(steps[0]) < steps[:, None]
    a, b = np.zeros(inside.shape, codes.dtype), np.ones(read.shape, codes.dtype)  # what is beyond an end matches nothing
    a[inside], b[read] = codes[: sizes.sum()], codes[sizes.sum() :]
    full = int.from_bytes(np.packbits(inside, axis=1, bitorder="little").tobytes(), "little")
    first = int.from_bytes((b"\x01" + bytes(width // 8 - 1)) * n, "little")
    plus, minus, out = full, 0, steps.copy()
    going = np.searchsorted(-steps, -np.arange(steps[0]), side="left")  # lines that go on at each step
    for start in range(0, int(steps[0]), COLUMNS):
        lanes = int(going[start])
        found = np.packbits(a[None, :lanes] == b[:lanes, start : start + COLUMNS].T[:, :, None], axis=2, bitorder="little")
        for at, match in enumerate(found.reshape(len(found), -1), start):
            match = int.from_bytes(match.tobytes(), "little")
            zero = (((match & plus) + plus) ^ plus) | match | minus
            up = minus | full & ~(zero | plus)
            down_ = plus & zero
            up = (up << 1 | first) & full
            plus = (down_ << 1) & full | full & ~(zero | up)
            minus = up & zero
            left = int(going[at + 1]) if at + 1 < len(going) else 0
            if left < n:  # the last lines are through
                rose, fell = (np.bitwise_count(np.frombuffer((x >> left * width).to_bytes((n - left) * width // 8, "little"), np.uint8)).reshape(n - left, -1).sum(axis=1, dtype=np.int64) for x in (plus, minus))
                out[left:n] += rose - fell
                n, kept = left, (1 << left * width) - 1
                plus, minus, full, first = plus & kept, minus & kept, full & kept, first & kept
    return out


def normal_lines(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The normalised lines that have words, the text of each and its number there."""
    data = "\n".join(t or "" for t in texts).lower().encode("utf-8", "replace").translate(NORMAL)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    lines = data.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")
    counts = np.array([(t or "").count("\n") + 1 for t in texts])
    rows = np.repeat(np.arange(len(texts)), counts)
    numbers = np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts)
    has = np.fromiter(map(bool, lines), bool, len(lines))
    return [x for x in lines if x], rows[has], numbers[has]


def digests(lines: list[bytes]) -> np.ndarray:
    """A row of two numbers, h and g, for each line."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x) for x in lines]), ">i8").reshape(-1, 2).astype(np.int64)


def shortened(line: str) -> set[str]:
    """What deletions leave of a line of at most SHORT characters: two such lines of edit similarity 0.8 share one."""
    out = last = {line}
    for _ in range(min(2, len(line) // 4)):
        last = {x[:k] + x[k + 1 :] for x in last for k in range(len(x))}
        out = out | last
    return out


def feature_places(hashes: np.ndarray, sizes: np.ndarray, width: int, name: int) -> np.ndarray:
    """A row of keys for each run of feature hashes: its bands of ``width`` minima and the blocks of its SimHash."""
    starts = np.cumsum(sizes) - sizes
    ones = np.empty((len(sizes), 8, 8), np.int64)
    for at in range(8):  # eight counters of a byte each in one number, for runs that cannot overflow them
        lanes = hashes >> np.uint64(at) & np.uint64(0x0101010101010101)
        if sizes.max() < 256:
            ones[:, :, at] = np.add.reduceat(lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        else:
            ones[:, :, at] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), starts, axis=0, dtype=np.int64)
    prints = np.packbits((2 * ones > sizes[:, None, None]).reshape(-1, 64), axis=1, bitorder="little").view("<u8")
    with np.errstate(over="ignore"):
        blocks = mixed((prints & BLOCKS) * np.uint64(0x9E3779B97F4A7C15) + np.arange(7, 7 + len(BLOCKS), dtype=np.uint64))
    return np.concatenate((band_keys(minima(hashes, starts, FACTORS[: BANDS * width]), width, name), blocks), axis=1)


def gram_places(lines: list[bytes]) -> np.ndarray:
    """The keys of lines by their grams of bytes."""
    padded = [b"\x02" + x.ljust(GRAM, b"\x03") + b"\x03" for x in lines]
    codes = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    sizes = np.array([len(x) for x in padded])
    grams = np.zeros(len(codes) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            grams = grams * np.uint64(1099511628211) + codes[j : j + len(grams)] + np.uint64(7)
        grams = mixed((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    for j in range(1, GRAM):  # grams that would run into the next line
        inside[ends - j] = False
    return feature_places(grams[inside[: len(grams)]], sizes - GRAM + 1, GRAM_WIDTH, 2000)


class Places:
    """Where normalised lines may meet those of edit similarity 0.8."""

    def __init__(self) -> None:
        import xxhash

        self.digest = xxhash.xxh64_intdigest
        self.powers = self.inverses = np.ones(1, np.uint64)

    def words(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, line) of the words that count: polynomials of their bytes, from running sums over all lines."""
        codes = np.frombuffer(b"\n" + b"\n".join(lines) + b"\n", np.uint8)
        with np.errstate(over="ignore"):
            if len(self.powers) < len(codes):
                base = 0x9E3779B97F4A7C15
                self.powers, self.inverses = (np.cumprod(np.append(np.uint64(1), np.full(2 * len(codes), np.uint64(x)))) for x in (base, pow(base, -1, 1 << 64)))
            ends = codes == 10
            between = np.flatnonzero(ends | (codes == 32))
            line = np.cumsum(ends[between])[:-1] - 1
            starts, sizes = between[:-1] + 1, np.diff(between) - 1
            counts = sizes >= LONG_WORD
            starts, sizes, line = starts[counts], sizes[counts], line[counts]
            sums = np.cumsum(codes * self.powers[: len(codes)])
            return mixed(mixed((sums[starts + sizes - 1] - sums[starts - 1]) * self.inverses[starts]) * np.uint64(0xBF58476D1CE4E5B9)), line

    def of(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, number of keys of each line) of normalised lines."""
        hashes, line = self.words(lines)
        counts = np.bincount(line, minlength=len(lines))
        by_words, by_grams = np.flatnonzero(counts >= WORDS_FROM), np.flatnonzero(counts < GRAMS_BELOW)
        short = {}
        for k in by_grams.tolist():
            if len(lines[k]) <= 4 * SHORT and len(text := lines[k].decode("utf-8", "replace")) <= SHORT:
                left = shortened(text)
                short[k] = np.fromiter((self.digest(v.encode(), 1) for v in left), np.uint64, len(left))
        n = BANDS + len(BLOCKS)
        sizes = n * ((counts >= WORDS_FROM).astype(np.int64) + (counts < GRAMS_BELOW))
        for k, keys in short.items():
            sizes[k] += len(keys)
        at = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), np.uint64)
        if len(by_words):
            out[at[by_words][:, None] + np.arange(n)] = feature_places(hashes[counts[line] >= WORDS_FROM], counts[by_words], WORD_WIDTH, 1000)
            at[by_words] += n
        if len(by_grams):
            out[at[by_grams][:, None] + np.arange(n)] = gram_places([lines[k] for k in by_grams.tolist()])
            at[by_grams] += n
        for k, keys in short.items():
            out[at[k] : at[k] + len(keys)] = keys
        return out, sizes


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, h, g, part, parcel): every line with words and the digest of its normal form, and, in rows of their
    own that have a part, where lines may meet others.

    A line that came before in the same piece of work has no places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, type_ = 0, None
        names = ["key", "n", "h", "g", "part", "parcel"]

        def packed() -> pa.RecordBatch:
            part, parcel = parcels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.record_batch([pa.nulls(len(part), x) for x in (type_, pa.int32(), pa.int64(), pa.int64())] + [part, parcel], names=names)

        for batch in batches:
            seen: set[bytes] = set()
            type_ = batch.column(0).type
            for at, texts in pieces(batch.column(1)):
                lines, rows, numbers = normal_lines(texts)
                if not lines:
                    continue
                digest = digests(lines)
                fresh = [k for k, x in enumerate(lines) if not (x in seen or seen.add(x))]
                if fresh:
                    keys, sizes = places.of([lines[k] for k in fresh])
                    held.append((keys, np.repeat(digest[fresh, 0], sizes)))
                    size += len(keys)
                yield pa.record_batch([batch.column(0).take(pa.array(rows + at)), pa.array(numbers, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.nulls(len(lines), pa.int32()), pa.nulls(len(lines), pa.binary())], names=names)
                if size >= AT_ONCE:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n int, h long, g long, part int, parcel binary")


def asked_lines(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """(h, g, payload): the normal forms of lines whose ``h`` is in the filter (a few others pass, none is lost)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                lines, _, _ = normal_lines(texts)
                names = digests(lines)
                found = passing(np.ascontiguousarray(names[:, 0]).view(np.uint64), bits)
                found = found[np.unique(names[found], axis=0, return_index=True)[1]]
                yield pa.record_batch([pa.array(names[found, 0]), pa.array(names[found, 1]), pa.array([lines[k].decode("utf-8", "replace") for k in found.tolist()], pa.string())], names=["h", "g", "payload"])

    out = docs.select(F.col(text).alias("text")).mapInArrow(run, "h long, g long, payload string")
    return out.groupBy("h", "g").agg(F.first("payload").alias("payload"))


def shared_places(table: np.ndarray) -> np.ndarray:
    """How many keys each two rows of a table share."""
    n = len(table)
    rows = np.repeat(np.arange(n), table.shape[1])
    order = np.argsort(table, axis=None, kind="stable")
    keys, rows = table.ravel()[order], rows[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(starts[1:], len(keys))
    out = np.zeros((n, n), np.int32)
    for k in np.flatnonzero(ends - starts > 1):
        found = np.unique(rows[starts[k] : ends[k]])
        out[np.ix_(found, found)] += 1
    np.fill_diagonal(out, 0)
    return out


def place_tables(payloads: list[list[str]]) -> list[np.ndarray | None]:
    """For each set of more than eight lines a row of sorted places for each line; what fills a row up is like no other."""
    large = [k for k, x in enumerate(payloads) if len(x) > 8]
    out: list[np.ndarray | None] = [None] * len(payloads)
    places, held, size = Places(), [], 0
    for k in large:
        held.append(k)
        size += sum(map(len, payloads[k]))
        if size < 1 << 18 and k != large[-1]:
            continue
        keys, sizes = places.of([x.encode() for j in held for x in payloads[j]])
        keys, ends, at = keys.view(np.int64), np.cumsum(sizes), 0
        for j in held:
            n = len(payloads[j])
            own = sizes[at : at + n]
            table = -np.arange(n * int(own.max())).reshape(n, -1).astype(np.int64)
            table[np.arange(table.shape[1]) < own[:, None]] = keys[ends[at] - own[0] : ends[at + n - 1]]
            out[j], at = np.sort(table, axis=1), at + n
        held, size = [], 0
    return out


#: Asks whether pairs of lines are similar, is told, and ends with the first member of each member's class.
Steps = Generator[list[tuple[str, str]], np.ndarray, np.ndarray]


def class_steps(lines: list[str], table: np.ndarray | None, similarity: float) -> Steps:
    """The classes of a set: those of all pairs that share a place, or of all pairs where there is no table."""
    n, seed = len(lines), np.arange(len(lines))
    if table is None:
        rest, names = list(range(n)), list(range(n))
        while len(rest) > 1:
            first, todo, rest = rest[0], [rest[0]], rest[1:]
            while todo and rest:
                at = lines[todo.pop()]
                told = yield [(at, lines[k]) for k in rest]
                found = [k for k, x in zip(rest, told, strict=True) if x]
                rest = [k for k, x in zip(rest, told, strict=True) if not x]
                todo += found
                for k in found:
                    names[k] = first
        return np.array(names)
    sizes, shares = np.array([len(x) for x in lines]), shared_places(table)
    shares[np.abs(sizes[:, None] - sizes) > ((1 - similarity) * np.maximum(sizes[:, None], sizes) + 1e-9).astype(np.int64)] = 0
    words = [x.split(" ") for x in lines]

    def join(a: int, b: int) -> None:
        if seed[a] != seed[b]:
            seed[seed == max(seed[a], seed[b])] = min(seed[a], seed[b])

    for at in range(n):
        for k in np.argsort(-shares[at], kind="stable")[:4].tolist():  # most classes come together by these
            if shares[at, k] and seed[at] != seed[k]:
                most = (1 - similarity) * max(sizes[at], sizes[k]) + 1e-9
                if aligned(words[at], words[k], most) <= most:
                    join(at, k)
    a, b = np.nonzero(np.tril(shares))
    order = np.argsort(-shares[a, b], kind="stable")
    a, b, most = a[order], b[order], 1
    while len(a):
        apart = seed[a] != seed[b]
        a, b = a[apart], b[apart]
        if not len(a):
            break
        # of each two classes the pairs that share most, more of them in each round
        two = np.minimum(seed[a], seed[b]) * n + np.maximum(seed[a], seed[b])
        order = np.argsort(two, kind="stable")
        starts = np.flatnonzero(np.append(True, two[order[1:]] != two[order[:-1]]))
        asked = np.zeros(len(a), bool)
        asked[order] = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < most
        one, other, a, b, most = a[asked], b[asked], a[~asked], b[~asked], 4 * most
        wide = np.bincount(one, minlength=n)[one] >= ALONE
        for at in np.unique(one[wide]).tolist():
            rest = other[one == at]
            rest = rest[seed[rest] != seed[at]]
            for some in np.split(rest, range(LANES, len(rest), LANES)):
                if len(some):
                    for k in some[close(lines[at], [lines[k] for k in some.tolist()], similarity)].tolist():
                        join(at, k)
        one, other = one[~wide].tolist(), other[~wide].tolist()
        if one:
            told = yield [(lines[x], lines[y]) for x, y in zip(one, other, strict=True)]
            for x, y, same in zip(one, other, told.tolist(), strict=True):
                if same:
                    join(x, y)
    return seed


def within(pairs: list[tuple[str, str]], least: float) -> np.ndarray:
    """``similar`` of many pairs."""
    out, hard = np.zeros(len(pairs), bool), []
    for k, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        allowed = int((1 - least) * longer + 1e-9)
        if a == b or abs(len(a) - len(b)) <= allowed and aligned(a.split(" "), b.split(" "), allowed) <= allowed:
            out[k] = True
        elif abs(len(a) - len(b)) <= allowed:
            hard.append((k, allowed))
    if hard:
        at, allowed = np.array(hard).T
        out[at] = distances([pairs[k] for k in at.tolist()]) <= allowed
    return out


def driven(sets: list[Steps], similarity: float) -> list[np.ndarray]:
    """What several sets end with; what they ask in a round is answered together."""
    out: list[np.ndarray] = [np.empty(0)] * len(sets)
    told: list[tuple[int, np.ndarray | None]] = [(k, None) for k in range(len(sets))]
    while told:
        asks, pairs = [], []
        for k, answer in told:
            try:
                asked = sets[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
                continue
            asks.append((k, len(pairs)))
            pairs += asked
        answers = within(pairs, similarity)
        told = [(k, x) for (k, _), x in zip(asks, np.split(answers, [at for _, at in asks[1:]]), strict=True)] if asks else []
    return out


def line_classes(payloads: list[list[str]], similarity: float) -> list[np.ndarray]:
    """The first member of each member's class, for each set of lines."""
    return driven([class_steps(x, table, similarity) for x, table in zip(payloads, place_tables(payloads), strict=True)], similarity)


def like_lines(similarity: float):
    """Preparation, neighbours, classes and neighbours by kind of lines: those that share a place and have the edit similarity."""

    def allowed(sizes: np.ndarray, size: int) -> np.ndarray:
        return ((1 - similarity) * np.maximum(sizes, size) + 1e-9).astype(np.int64)

    def prepare(payload: list[str]) -> tuple[list[str], np.ndarray | None]:
        return payload, place_tables([payload])[0]

    def near(items: tuple[list[str], np.ndarray | None], at: int, rest: np.ndarray) -> np.ndarray:
        lines, table = items
        if table is None:
            return np.array([k for k in rest.tolist() if similar(lines[at], lines[k], similarity)], np.int64)
        place = np.minimum(np.searchsorted(table[at], table[rest]), table.shape[1] - 1)
        rest = rest[(table[at][place] == table[rest]).any(axis=1)]
        sizes = np.array([len(lines[k]) for k in rest.tolist()], np.int64)
        rest = rest[np.abs(sizes - len(lines[at])) <= allowed(sizes, len(lines[at]))]
        found = [some[close(lines[at], [lines[k] for k in some.tolist()], similarity)] for some in np.split(rest, range(LANES, len(rest), LANES)) if len(some)]
        return np.concatenate(found) if found else rest

    def classes(items: tuple[list[str], np.ndarray | None], n: int) -> np.ndarray:
        """The first member of each member's class; pairs that share more come first, pairs inside a class are passed over."""
        return driven([class_steps(*items, similarity)], similarity)[0]

    def kinds_near(items: tuple[list[str], np.ndarray | None], at: int, rest: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """A neighbour of each kind that has any; what shares more comes first, a kind that is met is passed over."""
        lines, table = items
        if table is None:
            return near(items, at, rest)
        place = np.minimum(np.searchsorted(table[at], table[rest]), table.shape[1] - 1)
        shares = (table[at][place] == table[rest]).sum(axis=1)
        sizes = np.array([len(lines[k]) for k in rest.tolist()], np.int64)
        shares[np.abs(sizes - len(lines[at])) > allowed(sizes, len(lines[at]))] = 0
        order = np.argsort(-shares, kind="stable")[: np.count_nonzero(shares)]
        found, rest, lanes = [], rest[order], 16
        while len(rest):
            some, rest, lanes = rest[:lanes], rest[lanes:], min(4 * lanes, LANES)
            found.append(some[close(lines[at], [lines[k] for k in some.tolist()], similarity)])
            rest = rest[~np.isin(kinds[rest], kinds[found[-1]])]
        return np.concatenate(found) if found else rest

    return prepare, near, classes, kinds_near


def line_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, filter_power: int = 23) -> DataFrame:
    """(key, n, group, kept): every line with words; of each group the first (key, n) is kept.

    Null texts have no lines; blank lines are structure and not listed; a null key comes first;
    rows that repeat a key and a line number keep or lose that line together; extra columns
    are ignored; an empty table gives an empty result.  Texts of any length are read whole.
    Texts are fetched by their digest, so repeated and null keys lose no link.  Lines whose
    128-bit digests agree count as equal (below 10^-14 in all for 10^12 different lines).
    """
    table = stored(line_table(docs, key, text), "lines")
    lines = table.filter("part is null").select("key", "n", "h", "g")
    nodes = lines.groupBy("h", "g").agg(F.min(F.struct("key", "n")).alias("first"))
    nodes = stored(nodes.select("h", "g", "first", F.monotonically_increasing_id().alias("id")), "nodes")
    asked = stored(met_parcels(table.filter("part is not null").select("part", "parcel")), "met")
    texts = asked_lines(docs, text, filter_bits(asked, filter_power)).join(nodes.select("h", "g", "id"), ["h", "g"])
    members = stored(asked.join(texts, "h").select("root", F.col("id").alias("h"), "payload"), "members")

    roots = components(linked(members, *like_lines(similarity), most_bytes=PART_BYTES, many=lambda payloads: line_classes(payloads, similarity)))
    told = nodes.join(roots, nodes["id"] == roots["node"]).select("id", "first", "root")
    least = told.groupBy("root").agg(F.min("first").alias("stays"))
    changed = told.join(least, "root").select(F.col("id").alias("node"), F.col("root").alias("group"), "stays")
    named = nodes.join(changed, nodes["id"] == changed["node"], "left").select("h", "g", F.coalesce("group", "id").alias("group"), F.coalesce("stays", "first").alias("stays"))
    named = stored(named, "node-groups")
    for done in (asked, members, nodes):
        discard(done)
    out = lines.join(named, ["h", "g"]).select("key", "n", "group", F.struct("key", "n").eqNullSafe(F.col("stays")).alias("kept"))
    return out.withColumnRenamed("key", key)


def line_report(groups: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_lines, n_dropped, dropped) of every row of ``docs``: numbers of the lines that go, from 0.

    Rows without lines have 0, 0 and an empty list; rows that repeat a key share one count.
    """
    told = groups.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("kept")).alias("n_dropped"), F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("n")))).alias("dropped"))
    keys = docs.select(F.col(key).alias("k"))
    out = keys.join(told, keys["k"].eqNullSafe(told[key]), "left")
    return out.select(F.col("k").alias(key), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_lines(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts, in the same columns.

    Null and empty texts stay as they are; rows that repeat a key lose the same line numbers.
    """
    gone = groups.filter(~F.col("kept")).groupBy(F.col(key).alias("_k")).agg(F.collect_set("n").alias("_gone"))
    found = docs.join(gone, docs[key].eqNullSafe(gone["_k"]), "left")
    parts = F.split(F.col(text), "\n", -1)
    kept = F.filter(parts, lambda line, n: ~F.array_contains(F.col("_gone"), n))
    return found.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
