"""Export filters and formats, shard and quota accounting, splits, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import strip


def keep_for_export(docs: DataFrame, languages=None, domains=None, min_quality: float = 0.0, text="text", source="source", language="lang", domain="domain", quality="overall_quality") -> DataFrame:
    """Valid rows of the wanted languages and domains; rows without a quality pass any minimum."""
    out = docs.filter((F.coalesce(F.col(text), F.lit("")) != "") & (F.coalesce(F.col(source), F.lit("")) != ""))
    if "rejected" in docs.columns:
        out = out.filter(~F.coalesce(F.col("rejected"), F.lit(False)))
    if languages:
        out = out.filter(F.col(language).isin(*languages))
    if domains:
        out = out.filter(F.col(domain).isin(*domains))
    return out.filter(F.col(quality).isNull() | (F.col(quality) >= min_quality)) if min_quality else out


def plain_text(text: Column) -> Column:
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def json_text(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))


def json_full(docs: DataFrame) -> Column:
    return F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})


def prompt_response(text: Column) -> Column:
    """struct(prompt, response): cut at the first answer mark, else the text continues a fixed prompt."""
    mark = "\n\nAnswer:"
    at = F.instr(text, mark)
    cut = F.struct(strip(F.substr(text, F.lit(1), at - 1)).alias("prompt"), strip(F.substr(text, at + len(mark))).alias("response"))
    return F.when(at > 0, cut).otherwise(F.struct(F.lit("Continue the following text:").alias("prompt"), text.alias("response")))


def write_shards(docs: DataFrame, path: str, source: str = "source", max_records: int = 1_000_000) -> None:
    """JSON lines by source, at most ``max_records`` a file; the committer makes the write atomic."""
    docs.write.partitionBy(source).option("maxRecordsPerFile", str(max_records)).json(path)


def write_rolling(docs: DataFrame, path: str, source: str = "source", order: str = "doc_id", text: str = "text", max_records: int = 1_000_000, max_bytes: int = 1 << 30, suffix: str = "") -> None:
    """JSON lines by source and rolling shard, bounded by records and bytes; ``suffix`` marks a rejected sink's sources.

    A shard is a folder of its own, so that reading one back is a partition filter.
    """
    sized = docs.withColumn("_bytes", F.octet_length(text).cast("long"))
    placed = shard_ids(sized, source, order, "_bytes", max_records, max_bytes).drop("_bytes")
    placed.withColumn(source, F.concat(source, F.lit(suffix))).write.partitionBy(source, "shard").json(path)


def write_cleaned(lines: DataFrame, path: str, file: str = "file", line: str = "line", order: str = "line_no") -> None:
    """Cleaned lines as text, a folder for each input file, in their order."""
    rows = lines.repartitionByRange(file, order).sortWithinPartitions(file, order)
    rows.select(F.col(file).alias("file"), F.col(line).alias("value")).write.partitionBy("file").text(path)


def checksums(docs: DataFrame, path: str) -> DataFrame:
    """(file, sha256) of the written files."""
    files = docs.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def shard_ids(rows: DataFrame, group: str, order: str, size: str, max_records: int, max_bytes: int, after: bool = False) -> DataFrame:
    """Add ``shard``: a running sum that starts anew is a fold, made per group in key order.

    Before a row is added its shard ends if it holds ``max_records`` or the row would bring it to
    ``max_bytes``; with ``after`` it ends once it holds ``max_bytes``.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.LongType())])
    place, of = rows.columns.index(size), rows.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, records, held = None, 0, 0, 0
        for batch in batches:
            out = []
            for g, n in zip(batch.column(of).to_pylist(), batch.column(place).to_pylist(), strict=True):
                if g != now or not out and now is None:
                    now, shard, records, held = g, 0, 0, 0
                n = n or 0
                if after:
                    if held >= max_bytes:
                        shard, records, held = shard + 1, 0, 0
                elif records and (records >= max_records or held + n >= max_bytes):
                    shard, records, held = shard + 1, 0, 0
                records, held = records + 1, held + n
                out.append(shard)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "shard"])

    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def running_before(rows: DataFrame, group: str | None, order: str, size: str, name: str, parts: int = 64) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the rows of the group (or of all) with a lesser ``order``, a number.

    The range of ``order`` is cut at ``parts`` - 1 quantiles, the only values that reach the driver,
    so that a group of any size is summed by several tasks; each adds what the ranges before it hold.
    Equal orders fall into one range; null orders come first; an empty table gives an empty result.
    """
    cuts = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 1000).alias("c")).first()["c"]
    below = F.array(*[F.lit(c) for c in sorted(set(cuts or [0]))])
    placed = rows.withColumn("_range", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter(below, lambda c: F.col(order) > c))))
    by = [group] if group else []
    sums = placed.groupBy(*by, "_range").agg(F.sum(size).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias("_group") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    same = F.col("_range") == F.col("_at")
    met = placed.join(base, same & F.col(group).eqNullSafe(F.col("_group")) if group else same)
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn(name, F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_range", "_at", "_base", "_group")


def quota_admission(rows: DataFrame, group: str, order: str, size: str, quotas: DataFrame | None = None, most_bytes: int = 0) -> DataFrame:
    """Add used_before and admitted: rows pass while what came before is below the source's quota (0: none).

    ``most_bytes`` is a quota over all sources, in the same order.  What came before only grows, so
    a source that is paused stays so.
    """
    out = rows
    if quotas is not None:
        out = rows.join(quotas, group, "left")
    else:
        out = rows.withColumn("max_bytes", F.lit(0))
    out = running_before(out.withColumn("max_bytes", F.coalesce("max_bytes", F.lit(0))), group, order, size, "used_before")
    admitted = (F.col("max_bytes") == 0) | (F.col("used_before") < F.col("max_bytes"))
    if most_bytes:
        out = running_before(out, None, order, size, "all_before")
        admitted = admitted & (F.col("all_before") < most_bytes)
    return out.withColumn("admitted", admitted)


def manifest(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row: documents, characters, tokens and the map of documents by source."""
    by = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("c"), F.sum(F.expr(f"length({text}) div 4")).alias("t"))
    return by.agg(F.sum("n").alias("total_docs"), F.sum("c").alias("total_chars"), F.sum("t").alias("total_tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("source_breakdown"))


def seeded_order(docs: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """A full shuffle that any run repeats: order by a hash of key and seed."""
    return docs.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)


def train_val_split(names: DataFrame, name: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Add split: the max(1, n * fraction) names of the least seeded hash are val; a single name is train.

    ``names`` is a table of files or sources, which is small beside the data; it is ranked whole.
    """
    ranked = names.select(name).distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(name))), name)))
    total = ranked.agg(F.count(F.lit(1)).alias("_t"))
    cut = F.greatest(F.lit(1), F.floor(F.col("_t") * F.lit(fraction)))
    return ranked.join(F.broadcast(total)).select(name, F.when((F.col("_t") > 1) & (F.col("_r") <= cut), "val").otherwise("train").alias("split"))


def natural_key(name: Column) -> Column:
    """A key whose order is that of the name's text parts and numbers: each number follows its length."""
    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=\\d)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0)), part), "")


def natural_order(names: DataFrame, name: str) -> DataFrame:
    """Order by the name's text parts and numbers, digits by value."""
    return names.orderBy(natural_key(F.col(name)), name)
