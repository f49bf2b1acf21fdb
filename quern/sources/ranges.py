"""Files behind HTTP as a Spark data source: byte ranges are partitions, a broken one resumes where it stopped."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Range(InputPartition):
    def __init__(self, start: int, stop: int | None) -> None:
        self.start, self.stop = start, stop


class RangeReader(DataSourceReader):
    """``path``, and options start, part_bytes, piece_bytes, max_retries, retry_backoff, max_backoff, timeout."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.start = options["path"], int(options.get("start", 0))
        self.part, self.piece = int(options.get("part_bytes", 64 << 20)), int(options.get("piece_bytes", 1 << 20))
        self.retries, self.backoff = int(options.get("max_retries", 5)), float(options.get("retry_backoff", 2.0))
        self.most, self.timeout = float(options.get("max_backoff", 300)), float(options.get("timeout", 60))

    def partitions(self) -> list[Range]:
        """Parts of ``part_bytes``; one part where the server does not tell a size or ranges."""
        from urllib.request import Request, urlopen

        with urlopen(Request(self.url, method="HEAD"), timeout=self.timeout) as answer:
            size, ranges = answer.headers.get("Content-Length"), answer.headers.get("Accept-Ranges", "")
        if size is None or "bytes" not in ranges:
            return [Range(self.start, None)]
        return [Range(at, min(at + self.part, int(size))) for at in range(self.start, int(size), self.part)]

    def read(self, part: Range) -> Iterator[tuple[int, bytes]]:
        from http.client import HTTPException
        from urllib.request import Request, urlopen

        at, failed = part.start, 0
        while part.stop is None or at < part.stop:
            begun = at
            last = "" if part.stop is None else str(part.stop - 1)
            try:
                with urlopen(Request(self.url, headers={"Range": f"bytes={at}-{last}"}), timeout=self.timeout) as answer:
                    told = answer.headers.get("Content-Length")
                    due = part.stop if told is None or part.stop else int(told) + (at if answer.status == 206 else 0)
                    if answer.status == 200 and at:  # the server sent all: what came before is passed over
                        self.passed(answer, at)
                    while data := answer.read(self.piece if part.stop is None else min(self.piece, part.stop - at) or 1):
                        if part.stop is not None:
                            data = data[: part.stop - at]
                        yield at, data
                        at += len(data)
                        if part.stop is not None and at >= part.stop:
                            return
                if due is None or at >= due:
                    return
                raise OSError(f"{self.url} ended at {at} of {due}")
            except (OSError, HTTPException):
                failed = 1 if at > begun else failed + 1
                if failed > self.retries:
                    raise
                time.sleep(min(self.backoff**failed, self.most))

    def passed(self, answer, n: int) -> None:
        while n and (data := answer.read(min(n, self.piece))):
            n -= len(data)


class HttpRanges(DataSource):
    """``spark.dataSource.register(HttpRanges)``, then ``spark.read.format("http_ranges").load(url)``: (offset, content)."""

    @classmethod
    def name(cls) -> str:
        return "http_ranges"

    def schema(self) -> str:
        return "offset long, content binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)
