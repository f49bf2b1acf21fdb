"""WARC archives: writing, the monolithic-gzip normaliser, and indexed reading.

A monolithic archive is one gzip stream over all records, so nothing in it can be reached
without inflating everything before it.  The normaliser inflates such a file once, as a stream,
and rewrites every record as a gzip member of its own; a sidecar index beside the new archive
holds the offset, length, type and target of each record, so that any record can be read alone.

Archives are files, not tables: executors read and write them through pyarrow's filesystems in
the shared folder.  Every attempt of a task writes a name of its own and only names that a
finished task has returned are ever read, so lost or repeated attempts leave no trace in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import open_fs, shared_dir, shuffle_partitions, stored

#: Payload bytes after which an archive ends and the next begins.
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"


def record_head(fields: dict[str, str], length: int) -> bytes:
    """The version line and header block of one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _clean(value: object) -> str:
    """A header value: line breaks would end the field, so they are percent-encoded."""
    return "" if value is None else str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, head, body) of each record of an inflated stream; a truncated end raises."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    seen = 0
    while True:
        while (at := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("truncated WARC record")
                return
        head = bytes(held[: at + 4])
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        while len(held) < at + 8 + size:
            if not more():
                raise ValueError("truncated WARC record")
        body = bytes(held[at + 4 : at + 4 + size])
        del held[: at + 8 + size]
        seen = 0
        yield fields, head, body


def inflate(stream) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or more members, each inflated once; a stream cut short raises."""
    import zlib

    tool, data, open_member = zlib.decompressobj(31), stream.read(PIECE), False
    while data:
        open_member = True
        out = tool.decompress(data, PIECE)
        if out:
            yield out
        data = tool.unconsumed_tail
        if tool.eof:
            data = tool.unused_data
            tool, open_member = zlib.decompressobj(31), False
        if not data:
            data = stream.read(PIECE)
    if open_member:
        raise ValueError("the gzip stream ends within a member")


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of one gzip stream each; return (file, records) of those written.

    ``pages`` has page_id, url, payload (binary), digest, bytes, record_type and refers_to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zlib

        system, base = open_fs(folder)
        system.create_dir(base, recursive=True)
        out, tool, name, count, size, files, counts = None, None, "", 0, 0, [], []

        def end() -> None:
            nonlocal out
            if out is not None:
                out.write(tool.flush())
                out.close()
                files.append(name)
                counts.append(count)
                out = None

        for batch in batches:
            for page_id, url, payload, digest, n, kind, refers in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    name, count, size = f"mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, tool = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                kind, body = kind.as_py(), (payload.as_py() or b"")
                fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{_clean(page_id.as_py())}>", "WARC-Date": EPOCH, "WARC-Target-URI": _clean(url.as_py()), "WARC-Payload-Digest": f"sha256:{digest.as_py()}", "X-Payload-Length": str(n.as_py())}
                if kind == "revisit":
                    fields |= {"WARC-Refers-To": f"<urn:page:{_clean(refers.as_py())}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    body = b""
                out.write(tool.compress(record_head(fields, len(body)) + body + b"\r\n\r\n"))
                count, size = count + 1, size + len(body)
                if size >= archive_bytes:
                    end()
        end()
        yield pa.record_batch([pa.array(files, pa.string()), pa.array(counts, pa.int64())], names=["file", "records"])

    return stored(pages.select("page_id", "url", "payload", "digest", "bytes", "record_type", "refers_to").mapInArrow(run, "file string, records long"), "archives")


def normalise(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite each archive of (file, records) record by record; return (file, records, bytes).

    An archive whose stream ends early or that has another number of records raises.

    ``folder`` gets ``<name>.warc.gz`` of one member a record and ``<name>.idx``, lines of
    offset, length, type, record id and target, tab-separated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zlib

        system, base = open_fs(source)
        target, into = open_fs(folder)
        target.create_dir(into, recursive=True)
        for batch in batches:
            names, counts, sizes = [], [], []
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"rec-{uuid.uuid4().hex}"
                offset = count = 0
                with system.open_input_stream(f"{base}/{file}", compression=None) as data, target.open_output_stream(f"{into}/{name}.warc.gz", compression=None) as out, target.open_output_stream(f"{into}/{name}.idx", compression=None) as index:
                    for fields, head, body in read_records(inflate(data)):
                        tool = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = tool.compress(head + body + b"\r\n\r\n") + tool.flush()
                        out.write(member)
                        index.write(f"{offset}\t{len(member)}\t{fields.get('warc-type', '')}\t{fields.get('warc-record-id', '')}\t{fields.get('warc-target-uri', '')}\n".encode())
                        offset, count = offset + len(member), count + 1
                if count != expected:
                    raise ValueError(f"{file} has {count} records, {expected} were written")
                names.append(name)
                counts.append(count)
                sizes.append(offset)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    each = archives.select("file", "records").repartition(max(1, shuffle_partitions(archives.sparkSession)), "file")
    return stored(each.mapInArrow(run, "file string, records long, bytes long"), "normalised")


def read_indexed(archives: DataFrame, folder: str) -> DataFrame:
    """(record_id, record_type, refers_to, digest, payload_length, body_bytes, body_digest) of every record.

    Each record is reached through the sidecar index alone: seek, read its member, inflate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        system, base = open_fs(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{file}.idx", compression=None) as f:
                    lines = f.read().decode().split("\n")[:-1]
                rows = []
                with system.open_input_file(f"{base}/{file}.warc.gz") as data:
                    for line in lines:
                        offset, length = map(int, line.split("\t", 2)[:2])
                        [(fields, _, body)] = read_records([zlib.decompress(data.read_at(length, offset), 31)])
                        rows.append((fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"]), len(body), hashlib.sha256(body).hexdigest()))
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "record_type", "refers_to", "digest", "payload_length", "body_bytes", "body_digest"])

    each = archives.select("file").repartition(max(1, shuffle_partitions(archives.sparkSession)), "file")
    return each.mapInArrow(run, "record_id string, record_type string, refers_to string, digest string, payload_length long, body_bytes long, body_digest string")


def plan_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, bytes, record_type, refers_to) of every row.

    Of equal payloads of at least ``least`` bytes the smallest key is the response and the others
    revisit it.  Null html is an empty payload; rows that repeat the smallest key are responses
    too; rows with a null key are responses.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    small = rows.select("page_id", "digest", "bytes").filter(F.col("bytes") >= least)
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    # the short (key, digest) rows meet the groups; payloads travel by key, so that no group of copies gathers them
    revisits = small.join(first, "digest").filter(F.col("page_id") > F.col("first")).select("page_id", "digest", "first").distinct()
    met = rows.join(revisits, ["page_id", "digest"], "left")
    return met.select("page_id", "url", "payload", "digest", "bytes", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"))


def page_of(urn: Column) -> Column:
    """The integer of ``<urn:page:N>``; null where there is none."""
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as monolithic archives, normalise these, read the records back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to per row.  A record
    whose stored body doesn't match its header's digest raises.  An empty table gives no archive
    and an empty result; extra columns are ignored.
    """
    spark = pages.sparkSession
    mono, each = shared_dir(spark, "warc"), shared_dir(spark, "warc-records")
    written = write_monolithic(plan_revisits(pages, key, url, html), mono, archive_bytes)
    normal = normalise(written, mono, each)
    records = read_indexed(normal, each)
    sound = (F.col("record_type") == "revisit") | ((F.col("digest") == F.col("body_digest")) & (F.col("payload_length") == F.col("body_bytes")))
    return records.select(
        page_of(F.col("record_id")).alias(key),
        F.when(sound, F.col("payload_length")).otherwise(F.raise_error(F.lit("archived payload differs from its digest")).cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
