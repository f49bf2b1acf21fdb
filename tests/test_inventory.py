"""Sources behind HTTP, chunks, running sums, token tables, stream joins: against plain loops."""

import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quern.operators import export, metrics, runs, tokenizer
from quern.plans import inventory
from quern.sources import readers
from quern.sources.ranges import HttpRanges
from quern.streaming import streams


def server(data, ranges=True, broken=0):
    """A server of one file; its first ``broken`` answers stop half-way."""
    left = [broken]

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            if ranges:
                self.send_header("Accept-Ranges", "bytes")
            self.end_headers()

        def do_GET(self):
            first, last = 0, len(data) - 1
            if ranges:
                a, _, b = self.headers["Range"].removeprefix("bytes=").partition("-")
                first, last = int(a), int(b or last)
            body = data[first : last + 1]
            self.send_response(206 if ranges else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if left[0] > 0:
                left[0] -= 1
                body = body[: len(body) // 2]
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    out = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=out.serve_forever, daemon=True).start()
    return out


@pytest.mark.parametrize(("ranges", "broken", "start"), [(True, 0, 0), (True, 2, 7), (False, 1, 0)])
def test_http_ranges(spark, ranges, broken, start):
    data = random.Random(1).randbytes(5000)
    host = server(data, ranges, broken)
    spark.dataSource.register(HttpRanges)
    rows = spark.read.format("http_ranges").option("part_bytes", 1500).option("piece_bytes", 400).option("start", start).option("retry_backoff", 0.01).load(f"http://127.0.0.1:{host.server_port}/x").collect()
    host.shutdown()
    assert b"".join(r["content"] for r in sorted(rows, key=lambda r: r["offset"])) == data[start:]
    assert all(data[r["offset"] : r["offset"] + len(r["content"])] == r["content"] for r in rows)


def test_chunks_and_tail(spark):
    draw = random.Random(2)
    lines = [("a", k, "x" * draw.randint(0, 9)) for k in range(60)] + [("b", 0, "long" * 10)]
    told, chunk, held = {}, 0, 0
    for file, k, value in lines[:60]:
        if held >= 20:
            chunk, held = chunk + 1, 0
        told[file, k] = chunk
        held += len(value)
    table = spark.createDataFrame(lines, "file string, line_no long, value string")
    found = {(r["file"], r["line_no"]): r["chunk"] for r in readers.chunks(table, 20).collect()}
    assert found == told | {("b", 0): 0}
    files = spark.createDataFrame([(f"wk_{n}.txt", k, f"{n}-{k}" if k else " ") for n in (2, 10, 9) for k in range(3)], "file string, line_no long, value string")
    assert sorted(r["value"] for r in readers.tail(files, 3).collect()) == ["10-1", "10-2", "9-2"]


def test_links_and_paths(spark, tmp_path):
    pages = spark.createDataFrame([('<a href="x-pages-articles.xml.bz2"> <a href="x-pages-articles-multistream.xml.bz2">',), ('<a href="y-pages-articles.xml.bz2">',), ("none",)], "page string")
    assert [r[0] for r in pages.select(readers.dump_link(F.col("page"), "http://d/")).collect()] == ["http://d/x-pages-articles-multistream.xml.bz2", "http://d/y-pages-articles.xml.bz2", None]
    (tmp_path / "warc.paths").write_text("a\n\nb\nc\n")
    assert readers.archive_paths(spark, str(tmp_path / "warc.paths"), "h/", 2) == ["h/a", "h/b"]
    assert readers.archive_paths(spark, str(tmp_path / "absent"), "h/", 2, ("u", "v", "w")) == ["u", "v"]


def test_running_sums(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.randint(0, 400), draw.randint(0, 50)) for _ in range(600)]
    rows = list({(g, k): (g, k, n) for g, k, n in rows}.values())
    table = spark.createDataFrame(rows, "g string, k long, n long")
    for group in ("g", None):
        for r in export.running_before(table.dropDuplicates(["k"]) if group is None else table, group, "k", "n", "before", parts=7).groupBy(*([group] if group else [])).agg(F.collect_list(F.struct("k", "n", "before")).alias("x")).collect():
            held = 0
            for x in sorted(r["x"]):
                assert x["before"] == held
                held += x["n"]
    assert export.running_before(table.limit(0), "g", "k", "n", "before").count() == 0


def test_names_with_long_numbers(spark):
    names = ["f" + "9" * 25, "f" + "1" + "0" * 25, "f007", "f8", "F6"]
    out = export.natural_order(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert [r["name"] for r in out.collect()] == ["F6", "f007", "f8", "f" + "9" * 25, "f" + "1" + "0" * 25]


def test_token_tables(spark):
    model = tokenizer.BytePairs([(6 + ord("a"), 6 + ord("b")), (262, 6 + ord("c"))])
    texts = ["abcab", "", "é x\tabc"]
    rows = tokenizer.encode(spark.createDataFrame([(t,) for t in texts], "text string"), model)
    rows = rows.withColumn("ids", F.concat(F.array(F.lit(tokenizer.BOS)), "ids", F.array(F.lit(99_999))))
    assert [r["decoded"] for r in tokenizer.decode(rows, model).collect()] == texts
    assert tokenizer.decode(spark.createDataFrame([(None,)], "ids array<int>"), model).first()["decoded"] is None
    assert tokenizer.long_enough(rows).count() == 2


def test_stages_and_records(spark, tmp_path):
    stages = {"one": lambda d: d.withColumn("one", F.lit(1)), "two": lambda d: d.withColumn("two", F.lit(2))}
    assert runs.composed(spark.range(1), stages, {"one": False}).columns == ["id", "two"]
    with pytest.raises(ValueError, match="three"):
        runs.composed(spark.range(1), stages, {"three": True})
    row = runs.lineage(spark, "r", "m", "c", None, "h", {"b": 1, "a": 2}, {"loss": 1}).first()
    assert row["config_snapshot"] == '{"a": 2, "b": 1}' and row["metrics"] == {"loss": 1.0} and row["parent_checkpoint"] is None
    rates = metrics.stage_rates(spark.createDataFrame([("x",), ("y",), (None,)], "rule string"), "rule", {"a": ("x",), "b": ("y", "z")}).collect()
    assert [tuple(r) for r in rates] == [("a", 3, 2, 1, 33.3), ("b", 2, 1, 1, 50.0)]


def test_streams_join_and_fan_out(spark, tmp_path):
    for name, rows in (("left", [(1, "2024-01-01T00:00:00"), (2, "2024-01-01T00:00:00")]), ("right", [(1, "2024-01-01T00:05:00"), (2, "2024-01-01T01:00:00"), (3, "2024-01-01T00:00:00")])):
        spark.createDataFrame(rows, "k long, ts string").coalesce(1).write.json(str(tmp_path / name))
    opened = [streams.files(spark, str(tmp_path / name), "k long, ts timestamp") for name in ("left", "right")]
    seen = ([], [])
    both = streams.fan_out(*[lambda batch, n, to=to: to.extend(r["left_k"] for r in batch.collect()) for to in seen])
    streams.run_available(streams.joined(*opened, "k"), str(tmp_path / "c"), both)
    assert seen == ([1], [1])


def test_lines_skipped_in_many_small_files(spark, tmp_path):
    texts = {-3: "a\nb\nc\n\n d ", 0: "", 4: None, 5: "a\nb\nc\rd\ne", 6: "x\n\n\ny"} | {k: f"1\n2\n{k}" for k in range(10, 60)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = inventory.skipped_lines(spark, str(tmp_path))
    want = {(k, n, line) for k, t in texts.items() for n, line in enumerate((t or "").split("\n")) if n >= 2 and line}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert len(found.inputFiles()) < 20  # not one for each document
    (tmp_path / "a.txt").write_text("1\n2\r\n3\r4\n")
    assert [(r["line_no"], r["value"]) for r in readers.lines_after(spark, str(tmp_path / "a.txt"), 2).collect()] == [(2, "3"), (3, "4")]
