"""Readers on tiny files of every format."""

import gzip

from quern.sources import readers


def put(path, text, mode="w"):
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
        f.write(text)
    return str(path)


def test_wiki_pages(spark, tmp_path):
    body = "An article about the sea. " * 30
    page = lambda title, ns, text, extra="": f"<page><title>{title}</title><ns>{ns}</ns><id>7</id>{extra}<revision><id>70</id><timestamp>2024-01-01T00:00:00Z</timestamp><text>{text}</text></revision></page>"
    dump = "<mediawiki>" + page("The Sea", 0, body + " {{x|{{y}}}}") + page("Old", 0, body, '<redirect title="New" />') + page("Talk:X", 1, body) + page("List of seas", 0, body) + page("Sea (disambiguation)", 0, body) + "</mediawiki>"
    out = readers.wiki_pages(spark, put(tmp_path / "dump.xml", dump)).collect()
    assert [r["title"] for r in out] == ["The Sea"] and out[0]["url"].endswith("The_Sea") and out[0]["metadata"]["revision_id"] == "70" and "{{" not in out[0]["text"]


def test_posts_take_the_accepted_answer(spark, tmp_path):
    row = lambda **k: "<row " + " ".join(f'{a}="{b}"' for a, b in k.items()) + " />"
    long = "word " * 40
    text = "<posts>" + row(Id=3, PostTypeId=2, ParentId=1, Score=9, Body="better " + long) + row(Id=1, PostTypeId=1, AcceptedAnswerId=2, Score=5, Title="How?", Body=long, Tags="&lt;a&gt;&lt;b&gt;") + row(Id=2, PostTypeId=2, ParentId=1, Score=2, Body="accepted " + long) + row(Id=4, PostTypeId=1, Score=0, Title="low", Body=long) + "</posts>"
    out = readers.posts(spark, put(tmp_path / "posts.xml", text)).collect()
    assert len(out) == 1 and "accepted" in out[0]["text"] and out[0]["metadata"]["tags"] == "a,b" and out[0]["category"] == "a"


def test_preprints_and_code(spark, tmp_path):
    good = '{"id":"1","title":" T ","abstract":"%s","categories":"math.AG cs.LG"}' % ("proof " * 50)
    out = readers.preprints(spark, put(tmp_path / "a.jsonl", good + '\n{"id": broken\n{"id":"2","title":"x","abstract":"short","categories":"cs.X"}\n')).collect()
    assert len(out) == 1 and out[0]["domain"] == "mathematics" and out[0]["text"].startswith("T\n\nproof")
    code = '{"path":"src/a.PY","content":"%s"}\n{"filename":"b.exe","code":"%s"}' % ("x = 1 " * 30, "y" * 200)
    out = readers.code_files(spark, put(tmp_path / "c.jsonl", code)).collect()
    assert [r["title"] for r in out] == ["src/a.PY"] and out[0]["text"].startswith("# src/a.PY\n\nx = 1")


def test_books(spark, tmp_path):
    (tmp_path / "books").mkdir()
    body = "It was a dark night. " * 300
    put(tmp_path / "books" / "5-0.txt", f"x\n*** START OF THE PROJECT GUTENBERG EBOOK ***\n{body}\nEnd of the Project Gutenberg")
    put(tmp_path / "books" / "5.txt", "fallback " * 1000)
    put(tmp_path / "books" / "6.txt", body)
    catalog = put(tmp_path / "catalog.csv", 'Text#,Type,Issued,Title,Language,Authors,Subjects\n5,Text,2000,Night,en,"A, B",Fiction\n6,Sound,2000,S,en,C,Fiction\n7,Text,2000,T,fr,D,Poetry\n')
    out = readers.books(spark, catalog, str(tmp_path / "books"), subjects=("fiction",)).collect()
    assert [r["title"] for r in out] == ["Night"] and out[0]["text"].startswith("It was") and "Project" not in out[0]["text"]


def test_crawl(spark, tmp_path):
    def record(kind, url, html):
        body = f"HTTP/1.1 200 OK\r\nA: b\r\n\r\n{html}".encode() if kind == "response" else b"GET / HTTP/1.1\r\n\r\n"
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    page = "<html><script>var x</script><p>" + "visible words " * 30 + "</p></html>"
    data = gzip.compress(record("request", "http://a.org/", "")) + gzip.compress(record("response", "http://bad.org/", page)) + gzip.compress(record("response", "http://a.org/", "<p>tiny</p>")) + gzip.compress(record("response", "http://a.org/last", page))
    blocked = spark.createDataFrame([("bad.org",)], "host string")
    out = readers.crawl(spark, put(tmp_path / "x.warc.gz", data, "wb"), blocked).collect()
    assert [r["url"] for r in out] == ["http://a.org/last"] and "var x" not in out[0]["text"]


def test_lines_records_shards(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t" / "wk_1.txt", "x" * 600 + "\nshort\n\n" + "y" * 500)
    assert readers.text_lines(spark, str(tmp_path / "t")).count() == 2
    records = readers.json_records(spark, put(tmp_path / "r.jsonl", '﻿{"instruction":"a","output":"b"}\n\nnot json\n{"instruction":"c","output":"d"}\n'), "instruction string, output string")
    assert [tuple(r) for r in records.collect()] == [("a", "b"), ("c", "d")]
    docs = readers.text_lines(spark, str(tmp_path / "t"))
    docs.write.json(str(tmp_path / "out" / "kept"))
    docs.write.json(str(tmp_path / "out" / "rejected"))
    assert readers.shards(spark, [str(tmp_path / "out" / "kept"), str(tmp_path / "out" / "rejected")]).count() == 2
    assert readers.sampled_lines(spark, str(tmp_path / "t"), 1).count() == 1
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    assert [r[0] for r in readers.prune(names, only=("a", "b"), skip=("b",)).collect()] == ["a"]
