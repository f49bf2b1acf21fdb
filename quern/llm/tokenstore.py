"""Token ids in Parquet list columns, in ascending key order, for selective reads.

Layout of one table: ``key`` and ``at`` (ids of the file before the row) and ``n_tokens`` are
delta-encoded (format version 2, no dictionary), the ``ids`` list is dictionary-encoded; row
groups and pages have set sizes and the writer adds page indexes, so that a filter on the key
reads few pages and a read of the counts touches no ids.  Files follow each other in key order.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import shuffle_partitions

#: Chunks whose ids a worker remembers, and those it keeps when there are more: the most used ones.
REMEMBERED, KEPT = 120_000, 80_000
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 20
#: Bytes of the longest chunk that is merged beside others, and what stands for no merge.
WIDEST, NO_RANK = 32, 2**31 - 1


class Merges:
    """The merges of a byte-pair model, made in many words side by side.

    In each round every word makes its first merge of the least rank, which is the order of the
    library.  Words of more than ``WIDEST`` bytes are left to it, since rounds grow with the length.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, shown: dict[int, int]) -> None:
        self.inner = np.array([vocab[chr(shown[b])] for b in range(256)], np.int32)
        self.last = np.array([vocab[chr(shown[b]) + suffix] for b in range(256)], np.int32)
        pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter((rank for rank, _ in pairs.values()), np.int32, len(pairs))
        self.made = np.zeros(len(merges), np.int32)
        self.made[ranks] = np.fromiter((made for _, made in pairs.values()), np.int32, len(pairs))
        power = max(8, (4 * len(keys)).bit_length())  # slots of an open table, a quarter of them used at most
        self.shift, self.mask = np.uint64(64 - power), (1 << power) - 1
        self.keys, self.ranks = np.full(1 << power, -1, np.int64), np.full(1 << power, NO_RANK, np.int32)
        at = self.slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys one stays in a slot
            stays = self.keys[at] == keys
            self.ranks[at[stays]] = ranks[stays]
            keys, ranks, at = keys[~stays], ranks[~stays], (at[~stays] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of neighbours, NO_RANK where there is none or one is -1."""
        keys = left.astype(np.int64) << 32 | right
        at = self.slots(keys)
        found, out = self.keys[at], self.ranks[at]
        missed = np.flatnonzero(found != keys)
        out[missed] = NO_RANK
        rest = missed[found[missed] >= 0]
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def of(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words of 1 to WIDEST bytes, given one after the other."""
        starts, numbers, done = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64), []
        whole = self.inner[codes]
        whole[starts + sizes - 1] = self.last[codes[starts + sizes - 1]]
        widths = [0, 2, 4, 6, 8, 10, 12, 16, WIDEST]
        for least, width in zip(widths[:-1], widths[1:], strict=True):
            words = np.flatnonzero((sizes > least) & (sizes <= width))
            ids = np.full((len(words), width + 1), -1, np.int32)  # the last column stays free
            ids[:, :-1][np.arange(width) < sizes[words][:, None]] = whole[np.repeat(starts[words] - np.cumsum(sizes[words]) + sizes[words], sizes[words]) + np.arange(sizes[words].sum())]
            ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width)
            while len(words):
                at = ranks.argmin(axis=1)
                first = ranks.ravel()[np.arange(0, ranks.size, width) + at]
                goes = first < NO_RANK
                if not goes.all():
                    ended = ids[~goes]
                    numbers[words[~goes]] = np.count_nonzero(ended >= 0, axis=1)
                    done.append((words[~goes], ended[ended >= 0]))
                    words, ids, ranks, at, first = words[goes], ids[goes], ranks[goes], at[goes], first[goes]
                    if not len(words):
                        break
                after = np.arange(width) > at[:, None]
                ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
                ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
                flat, flat_ranks = ids.ravel(), ranks.ravel()
                place = np.arange(0, flat.size, width + 1) + at
                flat[place] = made = self.made[first]
                place_rank, has = np.arange(0, flat_ranks.size, width) + at, np.flatnonzero(at)
                told = self.rank(np.concatenate((made, flat[place[has] - 1])), np.concatenate((flat[place + 1], made[has])))
                flat_ranks[place_rank] = told[: len(made)]
                flat_ranks[place_rank[has] - 1] = told[len(made) :]
        before = np.cumsum(numbers) - numbers
        out = np.empty(numbers.sum(), np.int32)
        for words, ids in done:
            own = numbers[words]
            out[np.arange(len(ids)) + np.repeat(before[words] - np.cumsum(own) + own, own)] = ids
        return out, numbers


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, remembering the ids of each distinct chunk.

    White space only separates for this kind of tokenizer (its splitting pattern never matches
    any), so a text's ids are those of its chunks between ASCII white space.  Chunks of plain
    Latin letters with trailing punctuation are merged side by side, any other goes
    through the whole tokenizer.  ``end`` is the id that closes a text.
    """

    def __init__(self, file: str, end: int = 0) -> None:
        import json

        from tokenizers import Tokenizer

        self.end, self.whole = end, Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.plain = spec["pre_tokenizer"]["type"] == "Sequence" and (model.get("end_of_word_suffix") or "") != ""
        if not self.plain:
            raise ValueError("chunks can't be encoded apart with this tokenizer")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        shown = dict(zip([*shown, *hidden], [*shown, *range(256, 256 + len(hidden))], strict=True))
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"], shown)
        # bytes: 0 none of these, 1 letter, 2 punctuation that may end a chunk, 3 and 4 the two bytes of other Latin letters
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[[b for b in range(128) if chr(b).isalpha()]] = 1
        self.kinds[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
        self.kinds[0xC3:0xC7], self.kinds[0x80:0xC0] = 3, 4
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        #: The two bytes of the lower-cased letter by those of a letter, zero where it is none.
        self.latin = np.zeros((4, 64, 2), np.uint8)
        for c in map(chr, range(0xC0, 0x1BB)):
            small = c.lower().encode()
            if c.isalpha() and c != "\u0130" and len(small) == 2:
                a, b = c.encode()
                self.latin[a - 0xC3, b - 0x80] = list(small)
        self.at: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("i")
        self.uses = np.empty(0, np.int64)

    def turn(self) -> None:
        """Forget all chunks but the most used; what they were used before counts half from now on."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:KEPT])
        kept = kept[self.uses[kept] > 1]
        chunks, flat = list(self.at), np.frombuffer(self.flat, np.int32)  # chunks are numbered as they were put in
        starts, sizes = np.frombuffer(self.starts, np.int64)[kept], np.frombuffer(self.sizes, np.int32)[kept]
        self.uses = self.uses[kept] // 2
        self.at = {chunks[k]: n for n, k in enumerate(kept.tolist())}
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        flat = flat[np.arange(sizes.sum(dtype=np.int64)) + np.repeat(starts - before, sizes)]
        self.flat, self.starts, self.sizes = array("i", flat.tobytes()), array("q", before.tobytes()), array("i", sizes.tobytes())

    def learn(self, chunks: set[bytes]) -> None:
        """Remember new chunks; the empty one stands for the end of a text."""
        names = [x for x in chunks if x]
        flat, numbers = self.ids_of(names) if names else (np.empty(0, np.int32), np.empty(0, np.int64))
        if len(names) < len(chunks):
            names, flat, numbers = [*names, b""], np.append(flat, np.int32(self.end)), np.append(numbers, 1)
        self.at.update(zip(names, range(len(self.sizes), len(self.sizes) + len(names)), strict=True))
        self.starts.frombytes((len(self.flat) + np.cumsum(numbers) - numbers).astype(np.int64).tobytes())
        self.sizes.frombytes(numbers.astype(np.int32).tobytes())
        self.flat.frombytes(flat.astype(np.int32).tobytes())

    def ids_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of chunks that are not empty, one after the other."""
        codes, sizes = np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts, chunk, kinds = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(chunks)), sizes), self.kinds[codes]
        codes = self.lower[codes]
        follows = np.append(chunk[1:] == chunk[:-1], False)  # whether the next byte is of the same chunk
        after = np.append(kinds[1:], 0)
        other = (kinds == 0) | follows & (kinds == 2) & (after != 2) | ((kinds == 3) != (follows & (after == 4)))
        other[starts] |= kinds[starts] == 4
        two = np.flatnonzero((kinds == 3) & ~other)
        small = self.latin[codes[two] - 0xC3, codes[two + 1] - 0x80]
        codes[two], codes[two + 1] = small[:, 0], small[:, 1]
        other[two] |= small[:, 0] == 0
        plain = ~np.logical_or.reduceat(other, starts) & (sizes <= WIDEST)
        letters = np.add.reduceat(kinds != 2, starts, dtype=np.int64)[plain]
        pieces = np.stack((letters, sizes[plain] - letters), axis=1).ravel()
        flat, counts = self.merges.of(codes[plain[chunk]], pieces[pieces > 0])
        numbers = np.zeros(len(chunks), np.int64)
        both = np.zeros(len(pieces), np.int64)
        both[pieces > 0] = counts
        numbers[plain] = both.reshape(-1, 2).sum(axis=1)
        rest = np.flatnonzero(~plain).tolist()
        if not rest:
            return flat, numbers
        told = [self.encode_chunk(chunks[k].decode("utf-8", "replace")) for k in rest]
        numbers[rest] = [len(ids) for ids in told]
        ends, from_merges = np.cumsum(numbers), np.repeat(plain, numbers)
        out = np.empty(ends[-1], np.int32)
        out[from_merges] = flat
        out[~from_merges] = [i for ids in told for i in ids]
        return out, numbers

    def encode_chunk(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode_many(self, texts: list[bytes], closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in UTF-8, one after the other and each with its end if ``closed``, and the number of each."""
        if len(self.at) > REMEMBERED:
            self.turn()
        chunks, last = [], []
        for text in texts:
            # the tokenizer folds case itself, but tells its special tokens by the case they are written in
            chunks += text.split() if b"<|" in text else text.lower().split()
            if closed:
                chunks.append(b"")
            last.append(len(chunks))
        if new := set(chunks).difference(self.at):
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        uses = np.bincount(at, minlength=len(self.sizes))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        sizes = np.frombuffer(self.sizes, np.int32)[at].astype(np.int64) if len(at) else at
        ends = np.append(0, np.cumsum(sizes))
        numbers = np.diff(ends[np.append(0, last).astype(np.int64)])
        if not ends[-1]:
            return np.empty(0, np.int32), numbers
        places = np.arange(ends[-1]) + np.repeat(np.frombuffer(self.starts, np.int64)[at] - ends[:-1], sizes)
        return np.frombuffer(self.flat, np.int32)[places], numbers

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a text in UTF-8, without an end."""
        return self.encode_many([text], closed=False)[0]


#: The worker's encoders by file and end, kept between tasks.
ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(file: str, end: int) -> Encoder:
    """The worker's encoder of a file; memory that earlier work of this worker left unused goes back first."""
    from quern.llm import tokenstore

    pa.default_memory_pool().release_unused()
    if (file, end) not in tokenstore.ENCODERS:
        tokenstore.ENCODERS[file, end] = Encoder(file, end)
    return tokenstore.ENCODERS[file, end]


def _together(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and texts (null: empty) of a batch in runs of about TOGETHER bytes."""
    begun, size, texts = 0, 0, []
    for k, value in enumerate(batch.column(1), 1):
        texts.append(value.as_py() or b"")
        size += len(texts[-1])
        if size > TOGETHER or k == batch.num_rows:
            yield batch.column(0).slice(begun, k - begun), texts
            begun, size, texts = k, 0, []


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", row_group: int = 32 << 20, page: int = 128 << 10) -> None:
    """Encode every whole text, append ``end_id`` and write the table at ``path`` in key order.

    Null text counts as empty; null keys come first; rows that repeat a key follow each other in
    the order of their texts.  Other columns are ignored; an empty table is written as such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = _encoder(tokenizer_file, end_id), 0
        for keys, texts in (run for batch in batches for run in _together(batch)):
            flat, sizes = encoder.encode_many(texts)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.record_batch([keys, pa.array(at + offsets[:-1]), pa.array(sizes), ids], names=["key", "at", "n_tokens", "ids"])
            at += int(offsets[-1])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "text").select("key", F.col("text").cast("binary"))
    coded = dealt.mapInArrow(run, f"key {kind}, at long, n_tokens long, ids array<int>")
    writer = coded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", str(row_group)).option("parquet.page.size", str(page)).option("parquet.page.row.count.limit", "2000")
    writer = writer.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", str(1 << 20))
    for column in ("key", "at", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, start, n_tokens) of every row from the small columns alone.

    Only one count per file comes to the driver: files are written one per task and their number
    is that of the shuffle partitions.
    """
    rows = spark.read.parquet(path).select("key", "at", "n_tokens", F.col("_metadata.file_name").alias("file"))
    files = _file_starts(spark, path)
    return rows.join(files, "file").select("key", "file", (F.col("before") + F.col("at")).alias("start"), "n_tokens")


def _file_starts(spark: SparkSession, path: str) -> DataFrame:
    sums = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("key").alias("first"), F.sum("n_tokens").alias("n")).collect()
    before, out = 0, []
    for row in sorted(sums, key=lambda r: (r["first"] is not None, r["first"], r["file"])):
        out.append((row["file"], before))
        before += row["n"]
    return spark.createDataFrame(out, "file string, before long")


def read_tokens(spark: SparkSession, path: str, keys=None) -> DataFrame:
    """(key, ids) of the table; ``keys`` (a condition on ``key``) is pushed to the page index."""
    rows = spark.read.parquet(path).select("key", "ids")
    return rows if keys is None else rows.filter(keys)


def token_report(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every row, counted from the ids that the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            ids = batch.column(3)
            flat = np.asarray(ids.flatten()).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths()).astype(np.int64))))
            view = memoryview(flat).cast("B")
            sums = np.fromiter((crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.int64, len(ends) - 1)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends)), pa.array(sums)], names=["key", "file", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path)
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.select("key", F.col("_metadata.file_name").alias("file"), "at", "ids")
    told = rows.mapInArrow(run, f"key {kind}, file string, at long, n_tokens long, ids_crc32 long")
    return told.join(_file_starts(spark, path), "file").select(F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
