"""Benchmark decontamination by greedy string tiling.

Karp-Rabin hashes of all windows of ``least`` tokens, rolled over documents and benchmark items,
are the seeds on which the two are joined.  Of a pair of a document and an item only its shared
seeds are gathered, with their places on both sides: every common run of ``least`` tokens
and more is a row of neighbouring seeds.  The longest runs of unmarked tokens are marked first, without overlap,
then the next longest, down to ``least``.  The share of an item's tokens under tiles is its
coverage; as tiles may lie in any order, an item whose sentences were moved about is caught
like a verbatim one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored
from quern.llm.groups import by_run, filter_bits, mixed, passing, pieces

WORD = r"\w+"
BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 100_000


def roll(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all windows of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * BASE + ids[k : k + n]
    return out


class Tokens:
    """64-bit ids of the tokens of texts: lower-cased runs of word characters."""

    def __init__(self) -> None:
        import re

        import xxhash

        digest = xxhash.xxh64_intdigest

        class Known(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > REMEMBERED:
                    self.clear()
                n = self[word] = digest(word.encode("utf-8", "surrogatepass"))
                return n

        self.find, self.known = re.compile(WORD).findall, Known().__getitem__

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each)."""
        words = [self.find((t or "").lower()) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        return np.fromiter((i for w in words for i in map(self.known, w)), np.uint64, int(sizes.sum())), sizes


def seeds(ids: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, place, h, c) of all windows of ``width`` tokens that lie within a text; h and c are independent hashes."""
    values = roll(ids, width)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.flatnonzero(text[: len(values)] == text[width - 1 :]) if len(values) else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = mixed(values[inside] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(width))
        c = roll(mixed(ids ^ np.uint64(0x5851F42D4C957F2D)), width)[inside] >> np.uint64(32)
    return text[inside], place[inside], h, c.astype(np.uint32).view(np.int32)


def tiles(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles (doc place, item place, tokens) from the shared windows (doc[k], item[k]) of ``width`` tokens.

    Longest first, at equal length by place in the document and the item; no token is in two tiles.
    """
    order = np.lexsort((doc, doc - item))
    doc, item = doc[order].astype(np.int64), item[order].astype(np.int64)
    places = np.unique(doc[:, None] + np.arange(width))
    at = np.searchsorted(places, doc)  # places of one window are neighbours here too
    free_doc, free_item, out = np.ones(len(places), bool), np.ones(int(item.max()) + width, bool), []
    while True:
        fits = np.ones(len(doc), bool)
        for k in range(width):
            fits &= free_doc[at + k] & free_item[item + k]
        doc, item, at = doc[fits], item[fits], at[fits]
        if not len(doc):
            return out
        begins = np.flatnonzero(np.append(True, (np.diff(doc) != 1) | (np.diff(item) != 1)))
        lengths = np.diff(np.append(begins, len(doc))) + width - 1
        longest = int(lengths.max())
        for d, i, p in sorted(zip(doc[begins[lengths == longest]].tolist(), item[begins[lengths == longest]].tolist(), at[begins[lengths == longest]].tolist(), strict=True)):
            if free_doc[p : p + longest].all() and free_item[i : i + longest].all():
                free_doc[p : p + longest] = free_item[i : i + longest] = False
                out.append((d, i, longest))


def item_seeds(benchmark: DataFrame, item: str, text: str, least: int) -> DataFrame:
    """(b, item_id, size, width, i, h, c): the windows of every item; ``b`` names its row, shorter items are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            ids, sizes = tokens.of(batch.column(2).to_pylist())
            for width in range(1, least + 1):
                text, place, h, c = seeds(ids, sizes, width)
                has = np.minimum(sizes[text], least) == width
                text, place, h, c = text[has], place[has], h[has], c[has]
                rows = pa.array(text)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sizes[text], pa.int32()), pa.array(np.full(len(text), width), pa.int32()), pa.array(place, pa.int32()), pa.array(h.view(np.int64)), pa.array(c)], names=["b", "item_id", "size", "width", "i", "h", "c"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("b"), F.col(item).alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"b long, item_id {benchmark.schema[item].dataType.simpleString()}, size int, width int, i int, h long, c int")


def text_names(text: str) -> tuple:
    """Two columns that name a row's text: what a text contains does not depend on its row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole).alias("r"), F.xxhash64(F.lit("text"), whole).alias("s")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, least: int, threshold: float, filter_power: int) -> DataFrame:
    """(r, s, item_id, coverage, tiles, longest) of texts and items at or above ``threshold``, as a stored table."""
    wanted = stored(item_seeds(benchmark, item, item_text, least), "item-seeds")
    bits = filter_bits(wanted, filter_power)
    widths = [r["width"] for r in wanted.select("width").distinct().collect()]  # at most ``least`` numbers

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for first, texts in pieces(batch.column(2)):
                ids, sizes = tokens.of(texts)
                for width in widths:
                    row, place, h, c = seeds(ids, sizes, width)
                    met = passing(h, bits)
                    rows = pa.array(row[met] + first)
                    yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[met], pa.int32()), pa.array(h[met].view(np.int64)), pa.array(c[met])], names=["r", "s", "d", "h", "c"])

    found = docs.select(*text_names(text), F.col(text).alias("text")).mapInArrow(find, "r long, s long, d int, h long, c int").distinct()
    hits = found.join(wanted, ["h", "c"]).select("r", "s", "b", "item_id", "size", "width", "d", "i")
    kind = wanted.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, s, _, name, size, width, d, i in by_run(batches, 3):
            n, w, places = size[0], width[0], np.array(i)
            if len(np.unique(places[:, None] + np.arange(w))) < threshold * n - 1e-9:
                continue  # no tiling covers more than all shared windows together
            laid = tiles(np.array(d), places, w)
            share = sum(x[2] for x in laid) / n
            if share >= threshold - 1e-9:
                yield pa.record_batch([pa.array([r[0]]), pa.array([s[0]]), pa.array([name[0]], pa.int64()), pa.array([share]), pa.array([len(laid)], pa.int32()), pa.array([max(x[2] for x in laid)], pa.int32())], names=["r", "s", "item_id", "coverage", "tiles", "longest"])

    dealt = hits.repartition("r", "s", "b").sortWithinPartitions("r", "s", "b")
    return stored(dealt.mapInArrow(run, f"r long, s long, item_id {kind}, coverage double, tiles int, longest int"), "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 3, threshold: float = 0.8, filter_power: int = 23) -> DataFrame:
    """(key, item_id, coverage, tiles, longest, contaminated) of every pair at or above ``threshold``.

    Tokens are lower-cased runs of word characters.  All common runs of ``least`` tokens count (of
    a shorter item the whole); no pair is passed over.  Items without tokens match nothing; null
    texts count as empty; repeated rows give repeated pairs; null keys are returned; extra columns
    are ignored; empty tables give an empty result.  Texts of any length are read whole, once.
    Item ids must be integers.

    Nothing of the benchmark is collected but a filter of 2^``filter_power`` bits: document
    windows that miss it have no item; when it fills up, more windows travel to the join and the result is the same.
    """
    args = (text, item, item_text, least, threshold, filter_power)
    found = contaminated(docs, benchmark, *args).select("r", "s", "item_id", "coverage", "tiles", "longest", F.lit(True).alias("contaminated"))
    rows = docs.select(F.col(key).alias("_key"), *text_names(text))
    return rows.join(found, ["r", "s"]).select(F.col("_key").alias(key), "item_id", "coverage", "tiles", "longest", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 3, threshold: float = 0.8, filter_power: int = 23) -> DataFrame:
    """The rows of ``docs`` that no benchmark item covers, in all their columns.

    A row goes or stays by its text alone: null and empty texts stay, repeated rows share one
    fate, keys do not matter.  An empty benchmark drops nothing.
    """
    found = contaminated(docs, benchmark, text, item, item_text, least, threshold, filter_power)
    gone = stored(found.select(F.col("r").alias("_r"), F.col("s").alias("_s")).distinct(), "contaminated-texts")
    r, s = text_names(text)
    return docs.join(gone, (r == F.col("_r")) & (s == F.col("_s")), "left_anti")
