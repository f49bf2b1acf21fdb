"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import components, decontam, exactdedup, groups, katz, linededup, mixing, simhash, tokenstore, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column with a clashing name."""
    rows = [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (None, "lost key"), (4, "word " * 5000), (5, "  \n\n "), (6, "é ß İ 日本 <|endoftext|> don't")]
    return spark.createDataFrame([(k, t, "en", None, None, "x") for k, t in rows], DOCS + ", id string").withColumn("fp", F.lit(1)).withColumn("key", F.lit("k"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def settled(near):
    """Least index reachable, by repeated sweeps over a boolean matrix."""
    label = np.arange(len(near))
    while True:
        now = np.array([label[row].min() for row in near])
        if (now == label).all():
            return label
        label = now


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_pair_within_the_radius_meets():
    masks, rng = simhash.covering_masks(4), random.Random(1)
    for _ in range(2000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)
    for _ in range(2000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 1)))
        assert any(diff & int(m) == 0 for m in linededup.BLOCKS)


def test_wide_runs_lose_no_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    run = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(150)]))
    held, simhash.WIDE = simhash.WIDE, 64
    try:
        left, right = simhash._links(run, 4)
    finally:
        simhash.WIDE = held
    at = {int(v): k for k, v in enumerate(run)}
    near = np.eye(len(run), dtype=bool)
    for a, b in zip(np.concatenate(left), np.concatenate(right), strict=True):
        near[at[int(a)], at[int(b)]] = near[at[int(b)], at[int(a)]] = True
    assert (settled(near) == settled(np.bitwise_count(run[:, None] ^ run[None, :]) <= 4)).all()


def test_simhash_classes(docs, odd, empty):
    out = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    fp = out.fp.to_numpy().view(np.uint64)
    label = settled(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert (out.doc_id.to_numpy()[label] == out.component_id.to_numpy()).all()
    found = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert found[2] == found[3] == found[5] == (0, 2) and found[1][1] == 1 and len(found) == 7
    assert simhash.near_duplicates(empty).count() == 0
    kept = sorted((r["doc_id"] or 0) for r in simhash.keep_one(odd).collect())
    assert kept == [0, 1, 1, 2, 4, 6] and simhash.keep_one(empty).count() == 0


def test_similar_documents_keep_one(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        words = t.split()
        words[200] = "changed"
        rows.append((100 + k, " ".join(words)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(30))


def test_keep_one_decides_by_exact_similarity(spark):
    rng = random.Random(10)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        rows.append((k, " ".join(words)))
        # 45 shingles differ: 355 of 445 are shared (0.798); 44 differ: 356 of 444 (0.802)
        rows.append((100 + k, " ".join(words[: 404 - 45 + k % 2] + [f"n{rng.randrange(10**6)}" for _ in range(45 - k % 2)])))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(40)) | {100 + k for k in range(0, 40, 2)}


def test_keep_one_finds_and_spares(spark):
    rng = random.Random(12)
    rows, truth = [], {}
    for n, share in enumerate((0.67, 0.73, 0.77, 0.82, 0.85, 0.92)):
        for k in range(60):
            size = rng.choice((60, 200, 700))
            words = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
            other = round(size * (1 - share) / (1 + share))  # shingles that differ at the end
            key = 1000 * n + 2 * k
            rows += [(key, " ".join(words)), (key + 1, " ".join(words[: size + 4 - other] + [f"n{rng.randrange(10**6)}" for _ in range(other)]))]
            truth[key + 1] = (size - other) / (size + other) >= 0.8
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(k in kept for k, _ in rows if not k % 2) and all(k in kept for k, near in truth.items() if not near)
    caught = [k not in kept for k, near in truth.items() if near]
    assert sum(caught) >= 0.98 * len(caught)


def test_repeated_passages_do_not_decide_similarity(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{k}" for k in range(24))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(104)) for _ in range(8)]
    rows = [(k, t + (" " + shared) * 20) for k, t in enumerate(own)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(8))


def test_exact_dedup(spark, docs, odd, empty, tmp_path):
    rows = {r["doc_id"]: r for r in exactdedup.exact_duplicates(spark, f"{SF}/documents.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = {}
    for k, t in texts.items():
        groups.setdefault(t, []).append(k)
    for k, t in texts.items():
        r = rows[k]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[t]), len(groups[t]), k == max(groups[t])) and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    odd.write.parquet(str(tmp_path / "odd"))
    out = exactdedup.exact_duplicates(spark, str(tmp_path / "odd")).collect()
    assert len(out) == 8 and {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out if r["doc_id"] in (2, 3)} == {(2, 3, 2, False), (3, 3, 2, True)}
    empty.write.parquet(str(tmp_path / "empty"))
    assert exactdedup.exact_duplicates(spark, str(tmp_path / "empty")).count() == 0


def test_exact_dedup_splits_collisions_and_goes_on_over_batches(spark, docs, tmp_path):
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    weak = lambda text: F.substring(F.md5(text), 1, 1)
    strong = {tuple(r) for r in exactdedup.exact_duplicates(spark, str(tmp_path / "d"), per_batch=1).collect()}
    assert {tuple(r) for r in exactdedup.exact_duplicates(spark, str(tmp_path / "d"), digest=weak, per_batch=1).collect()} == strong


def test_tokens_round_trip(spark, docs, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    whole, coder = Tokenizer.from_file(file), tokenstore.Encoder(file)
    for text in ["a\x0bb\x0cc\x1cd\x85e\xa0f", "ΑΣ Σ İstanbul ǅ", "don't I'LL 'S x's", "<|startoftext|> A<|endoftext|>b <|STARTOFTEXT|>", "é ﬁ ½ 12,3 ²", "日本語 テスト", "_a_b __ ~!'", "😀a ŉ ª ſ K Å"]:
        assert coder.encode(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids
    for name, table in (("docs", docs), ("odd", odd), ("empty", empty)):
        path = str(tmp_path / name)
        tokenstore.write_tokens(table, path, file, 2)
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        start, want = 0, []
        for key, text in rows:
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = sorted(map(tuple, tokenstore.token_report(spark, path).collect()), key=lambda r: r[1])
        assert got == want
        assert sorted((r["start"], r["n_tokens"]) for r in tokenstore.read_index(spark, path).collect()) == [w[1:3] for w in want]
    assert len(tokenstore.read_tokens(spark, str(tmp_path / "docs"), F.col("key") == 7).collect()) == 1


def test_encoder_keeps_the_most_used_chunks(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokenstore, "REMEMBERED", 300)
    monkeypatch.setattr(tokenstore, "KEPT", 100)
    whole, coder, asked = Tokenizer.from_file(file), tokenstore.Encoder(file, 2), Counter()
    plain = coder.encode_chunk
    coder.encode_chunk = lambda text: asked.update([text]) or plain(text)
    rng = random.Random(7)
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "sea,", "été", "x1"]) if k % 2 else f"w{'abcdefgh'[rng.randrange(8)]}{rng.randrange(9999)}q" for k in range(40)) for _ in range(3)] + ["", " "]
        flat, sizes = coder.encode_many([t.encode() for t in texts])
        ids = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert flat.tolist() == sum(ids, []) and sizes.tolist() == [len(x) for x in ids]
    assert len(coder.at) < 500 and max(asked[t] for t in ("the", "sea,", "été", "x1")) == 1


def test_alignment_stops_beyond_what_is_allowed():
    read = []

    class Word(str):
        def __eq__(self, other):
            read.append(self)
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    a, b = [f"one{k}" for k in range(500)], [f"two{k}" for k in range(500)]
    assert linededup.aligned([Word(x) for x in a], b, 20) > 20 and len(read) < 100
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcdef") * rng.randrange(1, 5) for _ in range(rng.randrange(30))]
        b = [w for w in a if rng.random() > 0.1] + ["z"] * rng.randrange(3)
        full, most = linededup.aligned(a, b), rng.randrange(40)
        assert full >= linededup.distance(" ".join(a), " ".join(b), 10**6)
        assert (linededup.aligned(a, b, most) <= most) == (full <= most)


def test_plain_chunks_are_merged_side_by_side():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    whole, coder, asked = Tokenizer.from_file(file), tokenstore.Encoder(file, 2), []
    plain = coder.encode_chunk
    coder.encode_chunk = lambda text: asked.append(text) or plain(text)
    rng = random.Random(5)
    latin = [chr(c) for c in range(0xC0, 0x1BB) if c != 0x130 and chr(c).isalpha()]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 20))) for _ in range(3000)] + ["".join(rng.choice([*"aeiorst", *latin]) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    words += [w + "".join(rng.choice("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~") for _ in range(rng.randrange(1, 6))) for w in words[::3]] + [*latin, *"aZ.,", "...", "$$$"]
    odd = ["don't", "x.y", ".x", "a1", "é×", "÷", "İ", "ƻ", "e\u0301", "ñ日", "日", "\u212a", "ẞ", "w" * 33, "é" * 17, "é" * 500, "a\x85b", "'", "😀é"]
    for some, lower in ((words, False), (odd, False), ([w.upper() for w in words[:500]] + ["<|x"], True)):
        flat, sizes = coder.encode_many([" ".join(some).encode(), b"", *(w.encode() for w in some)])
        ids = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in (" ".join(some), "", *some)]
        assert flat.tolist() == sum(ids, []) and sizes.tolist() == [len(x) for x in ids]
        assert set(asked) <= {*odd, *map(str.lower, odd), "<|x", *(w for w in some if lower and len(w.encode()) != len(w.lower().encode()))}
    cut = b"caf\xc3 \xc3.\xa9 \xc3\xc3 \x80a na\xc3\xafve\xc3"
    assert coder.encode(cut).tolist() == whole.encode(cut.decode("utf-8", "replace"), add_special_tokens=False).ids


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (4, "u", "tiny"), (6, "u", "tiny"), (7, "u", None), (8, "u", ""), (5, "http://a/", big), (10, "u", "y" * 300_000), (None, "u", "z" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages, archive_bytes=1000).collect()}
    want = set()
    for k, _, html in rows:
        raw = (html or "").encode()
        least = min((p for p, _, h in rows if h == html and p is not None), default=k)
        again = len(raw) >= 100 and k is not None and k > least
        want.add((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    assert out == want
    assert warc.archive_pages(spark.createDataFrame([], pages.schema)).count() == 0
    with pytest.raises(ValueError):
        list(warc.read_records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))


def test_an_unfinished_gzip_stream_fails():
    import gzip
    import io

    whole = gzip.compress(b"a" * 5000) + gzip.compress(bytes(range(256)) * 40)
    assert b"".join(warc.inflate(io.BytesIO(whole))) == b"a" * 5000 + bytes(range(256)) * 40
    for cut in (1, 8, 30):  # without the end, without the checksum, within the data
        with pytest.raises(ValueError):
            list(warc.inflate(io.BytesIO(whole[:-cut])))


def test_url_rules_and_ratio(spark):
    rng = random.Random(2)
    urls = [f"http://h{rng.randrange(99)}.example.net/en/{rng.randrange(999)}" for _ in range(60)] + [f"http://h{rng.randrange(99)}.cheap.net/pills/{rng.randrange(999)}" for _ in range(60)]
    odd = [None, "", "no scheme", "HTTP://A.ORG/fr/x?y#z", "http://NET", "http://x.net/a", "ftp://example.com/de/", "http://notexample.com/de/", "http://q.org/es/cheap/pills/1", "http://h1.example.org/en/1"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls + odd)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    n = len(urls)
    assert [(out[n + k]["host"], out[n + k]["path"], out[n + k]["rule"]) for k in range(8)] == [("", "", None), ("", "", None), ("", "", None), ("a.org", "/fr/x", "org/fr/"), ("net", "", None), ("x.net", "/a", "net/"), ("example.com", "/de/", "example.com/de/"), ("notexample.com", "/de/", None)]
    assert out[0]["verdict"] == "allow" and out[70]["verdict"] == "block" and out[n + 3]["verdict"] == "allow"
    assert out[n + 8]["verdict"] == "block" and out[n + 9]["verdict"] == "allow"
    assert urlfilter.judge(pages.limit(0)).count() == 0


def plain_url_model(urls, order):
    """Counts of the bytes after each context, by loops; contexts seen once are left out."""
    counts = {}
    for url in urls:
        for at, byte in enumerate(url):
            for n in range(min(order, at) + 1):
                counts.setdefault(url[at - n : at], Counter())[byte] += 1
    counts = {c: row for c, row in counts.items() if not c or sum(row.values()) > 1}

    def chance(context, byte):
        below = chance(context[1:], byte) if context else 1 / 256
        row = counts.get(context)
        return below if not row else (row[byte] + len(row) * below) / (sum(row.values()) + len(row))

    return chance


def test_url_models_count_every_labelled_url(spark):
    from math import log

    rng = random.Random(4)
    rows = list({(f"http://{v}{rng.randrange(10**6)}.org/{'é' if k % 9 else 'x' * 3000}/{rng.randrange(99)}", v) for k in range(9000) for v in ("allow", "block") if v == "allow" or k % 9 == 0})
    table = spark.createDataFrame(rows, "url string, verdict string")
    held = {r[0] for r in table.filter("pmod(xxhash64(url), 5) = 0").collect()}
    sides = {v: [u.encode() for u, w in rows if w == v and u not in held] for v in ("allow", "block")}
    assert len(sides["allow"]) > 4000 and max(map(len, sides["block"])) > 2048
    ratio, at = urlfilter.train(table.union(table.limit(50)))
    for v, model in (("allow", ratio.accepted), ("block", ratio.rejected)):
        assert model.totals[0] == sum(map(len, sides[v]))
    chances = {v: plain_url_model(urls, 4) for v, urls in sides.items()}
    some = [b"http://allow7.org/\xc3\xa9/1", b"\xff\x00zz", b"", None, sides["block"][0]]
    want = [sum(log(chances["allow"](u[max(0, k - 4) : k], u[k]) / chances["block"](u[max(0, k - 4) : k], u[k])) for k in range(len(u))) / max(1, len(u)) for u in (u or b"" for u in some)]
    assert np.allclose(ratio.scores(pa.array(some, pa.binary())), want, rtol=1e-9, atol=1e-12)
    score = lambda v: ratio.scores(pa.array([u.encode() for u, w in rows if w == v and u in held], pa.binary()))
    good, bad = score("allow"), score("block")
    gain = lambda t: (good >= t).mean() + (bad < t).mean()
    assert gain(at) >= max(map(gain, np.concatenate((good, bad)))) - 1e-12
    scored = [(0.5, 3, 1), (-1.0, 0, 4), (0.25, 1, 2), (2.0, 9, 0)]
    assert urlfilter.calibrate(spark.createDataFrame(scored, "score double, good long, bad long")) == 0.375


def test_markov_model_is_normalised():
    model = urlfilter.MarkovModel(3).fit([b"abcab", b"abd"])
    for context in (b"", b"a", b"ab", b"zz"):
        assert abs(sum(model.chance(context, b) for b in range(256)) - 1) < 1e-9


def test_toxicity_learns_and_locates(spark, odd, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        sentences = [" ".join(f"n{rng.randrange(300)}" for _ in range(8)) for _ in range(6)]
        if k % 4 == 0:
            sentences[rng.randrange(6)] += f" bad{'abcdef'[k % 6]}word"
        rows.append((k, ". ".join(sentences) + "."))
        labels.append((k, int(k % 4 == 0)))
    table, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(table, told)
    out = {r["doc_id"]: r for r in toxicity.score_documents(table, model).collect()}
    held = [k for k in out if out[k]["held_out"]]
    assert held and all(out[k]["predicted"] == int(k % 4 == 0) for k in held)
    for k in held:
        if k % 4 == 0:
            assert [rows[k][1][s["start"] : s["end"]] for s in out[k]["sentences"]] and all("bad" in rows[k][1][s["start"] : s["end"]] for s in out[k]["sentences"])
    assert {r["doc_id"] for r in toxicity.drop_toxic(table, model).collect()} == {k for k in out if not out[k]["predicted"]}
    strange = toxicity.score_documents(odd, model).collect()
    assert len(strange) == 8 and all(0 <= r["score"] <= 1 for r in strange)
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.train(table, told.filter("toxic = 0"))
    assert toxicity.score_documents(table, none).filter("predicted = 1").count() == 0


def plain_tiles(doc, item, least):
    """Greedy string tiling as defined: all longest common runs of unmarked tokens, marked in order, again and again."""
    used_doc, used_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least, []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not used_doc[d + n] and not used_item[i + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((d, i))
        if not found:
            return out
        for d, i in found:
            if not any(used_doc[d : d + best]) and not any(used_item[i : i + best]):
                used_doc[d : d + best] = used_item[i : i + best] = [True] * best
                out.append((d, i, best))


def shared_windows(doc, item, width):
    pairs = [(d, i) for d in range(len(doc) - width + 1) for i in range(len(item) - width + 1) if doc[d : d + width] == item[i : i + width]]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def test_tiles_are_those_of_greedy_string_tiling():
    rng = random.Random(4)
    for _ in range(600):
        doc, item = [rng.randrange(1, 5) for _ in range(30)], [rng.randrange(1, 5) for _ in range(12)]
        d, i = shared_windows(doc, item, 3)
        assert (decontam.tiles(d, i, 3) if len(d) else []) == plain_tiles(doc, item, 3)


def test_tiling_catches_reordered_passages(spark, odd, empty):
    rng = random.Random(9)
    items = [(k, " ".join(f"i{rng.randrange(2000)}" for _ in range(40))) for k in range(20)]
    items += [(90, "tiny one"), (91, ""), (92, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noise = lambda n: " ".join(f"z{rng.randrange(900)}" for _ in range(n))
    words = items[0][1].split()
    pieces = [words[k : k + 4] for k in range(0, 40, 4)]
    rng.shuffle(pieces)
    cases = {1: f"{noise(50)} {items[3][1]} {noise(9)}", 2: " ".join([noise(5), *words[20:], noise(4), *words[:20]]), 3: " ".join(words[:25]), 4: noise(300), 5: f"A TINY, ONE {noise(3)}", 6: " ".join(words[10:20] * 3)}
    cases |= {7: " ".join(f"{' '.join(p)} {noise(1)}" for p in pieces), 8: " ".join("changed" if k % 5 == 4 else w for k, w in enumerate(words)), 9: noise(30_000) + " " + items[7][1], 10: items[3][1]}
    table = spark.createDataFrame([(k, t) for k, t in cases.items()] + [(1, cases[1])], "doc_id long, text string").withColumn("h", F.lit("clash"))
    found = decontam.contamination(table, bench).collect()
    out = {(r["doc_id"], r["item_id"]): r["tiles"] for r in found}
    assert out == {(1, 3): 1, (2, 0): 2, (5, 90): 1, (7, 0): 10, (8, 0): 8, (9, 7): 1, (10, 3): 1} and len(found) == 8
    rest = decontam.drop_contaminated(table, bench)
    assert sorted(r["doc_id"] for r in rest.collect()) == [3, 4, 6] and rest.columns == table.columns
    assert decontam.contamination(odd, bench).count() == 0 and decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(table, bench.limit(0)).count() == 0 and decontam.drop_contaminated(odd, bench).count() == 8


def test_contamination_is_that_of_all_pairs(spark, docs):
    import re

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    find, want = re.compile(r"\w+").findall, {}
    for r in docs.collect():
        doc = find(r["text"].lower())
        places = {}
        for d in range(len(doc) - 2):
            places.setdefault(tuple(doc[d : d + 3]), []).append(d)
        for b in bench.collect():
            item = find(b["text"].lower())
            pairs = [(d, i) for i in range(len(item) - 2) for d in places.get(tuple(item[i : i + 3]), [])]
            if len({i + k for _, i in pairs for k in range(3)}) < 0.8 * len(item):
                continue
            # runs that touch shared windows alone can be tiles
            near = sorted({d + k for d, _ in pairs for k in range(3)})
            cut = [x for k, p in enumerate(near) for x in ([None] if k and near[k - 1] != p - 1 else []) + [doc[p]]]
            share = sum(n for _, _, n in plain_tiles(cut, item, 3)) / len(item)
            if share >= 0.8:
                want[r["doc_id"], b["item_id"]] = share
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.contamination(docs, bench).collect()}
    assert want and found == pytest.approx(want)


def test_edit_distance():
    rng = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert linededup.distance(a, b, 99) == plain(a, b)
        assert linededup.similar(a, b, 0.8) == (not max(len(a), len(b)) or 1 - plain(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9)


def near_lines(docs):
    """{normal line: its (doc_id, n)} and the matrix of edit similarity 0.8, by comparing all pairs."""
    lines = {}
    for r in docs.collect():
        for n, line in enumerate(r["text"].split("\n")):
            if words := line.lower().encode().translate(bytes.maketrans(b"123456789", b"000000000")).split():
                lines.setdefault(b" ".join(words).decode(), []).append((r["doc_id"], n))
    keys = list(lines)
    near = np.zeros((len(keys), len(keys)), bool)
    for i in range(len(keys)):
        for j in range(i + 1):
            near[i, j] = near[j, i] = linededup.similar(keys[i], keys[j], 0.8)
    return lines, near


def test_fuzzy_lines(spark, docs, odd, empty):
    lines, near = near_lines(docs)
    keys, label = list(lines), settled(near)
    found = linededup.line_groups(docs)
    groups, stays = {}, set()
    for r in found.collect():
        groups[r["doc_id"], r["n"]] = r["group"]
        if r["kept"]:
            stays.add((r["doc_id"], r["n"]))
    assert set(groups) == {x for places in lines.values() for x in places}
    of = [{groups[x] for x in lines[k]} for k in keys]
    assert all(len(x) == 1 for x in of)  # equal normal lines are one
    of = [x.pop() for x in of]
    pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    recall = sum(of[i] == of[j] for i, j in pairs) / len(pairs)
    print("recall of pairs of edit similarity 0.8:", recall, len(pairs))
    assert recall >= 0.95
    for group in set(of):  # nothing is joined that brute force keeps apart
        assert len({label[k] for k in range(len(keys)) if of[k] == group}) == 1
    firsts = {}
    for x, group in groups.items():
        firsts[group] = min(firsts.get(group, x), x)
    assert stays == set(firsts.values())
    report = linededup.line_report(found, docs).collect()
    assert {(r["doc_id"], n) for r in report for n in r["dropped"]} == set(groups) - stays and len(report) == docs.count()
    cleaned = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs, found).collect()}
    for r in docs.collect():
        assert cleaned[r["doc_id"]] == "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], n) in stays or (r["doc_id"], n) not in groups)
    assert linededup.line_groups(odd).filter("not kept").count() == 0 and linededup.line_report(linededup.line_groups(odd), odd).count() == 8
    assert linededup.line_groups(empty).count() == 0
    short = [(1, "abcde fgh"), (2, "abxde fgh"), (3, "zzzz yyyy xx"), (4, "zzzz yyy xxq")]
    assert linededup.line_groups(spark.createDataFrame(short, "doc_id long, text string")).filter("kept").count() == 2


def test_distances_of_many_lines_at_once():
    draw = random.Random(1)

    def plain(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    for _ in range(100):
        text = "".join(draw.choice("ab \u00e9") for _ in range(draw.randint(1, 40)))
        others = ["".join(draw.choice("abc\u00e9\0") for _ in range(draw.randint(1, 40))) for _ in range(5)] + [text[:k] + "x" + text[k + 2 :] for k in range(0, len(text), 3)]
        for least in (0.8, 0.4):
            told = [plain(text, x) <= int((1 - least) * max(len(text), len(x)) + 1e-9) for x in others]
            assert linededup.close(text, others, least).tolist() == told


def test_best_first_classes_are_those_of_all_pairs():
    """Classes of copies with random changes, against a loop over every pair that shares a place."""
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(4, 9))) for _ in range(300)]
    lines = []
    for _ in range(4):
        base = [draw.choice(words) for _ in range(30)]
        lines += [" ".join(draw.choice(words) if draw.random() < share else w for w in base) for share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3) for _ in range(5)]
    lines = sorted(set(lines))
    prepare, _, classes, kinds_near = linededup.like_lines(0.8)
    items = prepare(lines)
    shares = linededup.shared_places(items[1])
    told = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if shares[a, b] and linededup.distance(lines[a], lines[b], 10**9) <= int(0.2 * max(len(lines[a]), len(lines[b])) + 1e-9):
                u, v = sorted((told[a], told[b]))
                told = [u if x == v else x for x in told]
    assert 4 < len(set(told)) < len(lines)
    assert classes(items, len(lines)).tolist() == told
    kinds = np.array([k % 3 for k in range(len(lines))])
    for at in range(len(lines)):  # one of each kind that has a neighbour, and neighbours alone
        rest = np.array([k for k in range(len(lines)) if k != at])
        near = {k for k in rest.tolist() if shares[at, k] and linededup.distance(lines[at], lines[k], 10**9) <= int(0.2 * max(len(lines[at]), len(lines[k])) + 1e-9)}
        found = set(kinds_near(items, at, rest, kinds).tolist())
        assert found <= near and {kinds[k] for k in found} == {kinds[k] for k in near}


def test_lines_of_many_sets_are_compared_together(monkeypatch):
    """Many small sets give the classes of each set alone, in few runs over columns."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh\u00e9") for _ in range(draw.randint(1, 9))) for _ in range(200)]

    def copy(line: str, share: float) -> str:
        return "".join(draw.choice("xyz") if draw.random() < share else c for c in line)

    sets = []
    for size in [2] * 200 + [3, 5, 8, 9, 20, 60]:
        base = " ".join(draw.choice(words) for _ in range(draw.randint(3, 30)))
        sets.append(sorted({copy(base, draw.choice((0.02, 0.1, 0.14))) for _ in range(size)}))
    sets += [["same start", "same start and more"], ["a", "b"], ["abc", "abcd"], ["x" * 300, "y" * 300]]
    runs, columns = [], linededup.columns
    monkeypatch.setattr(linededup, "columns", lambda *x: runs.append(len(x[0])) or columns(*x))
    found = linededup.line_classes(sets, 0.8)
    assert len(runs) < 60 and sum(runs) > 150
    for lines, seed, table in zip(sets, found, linededup.place_tables(sets), strict=True):
        shares = linededup.shared_places(table) if table is not None else np.ones((len(lines), len(lines)))
        told = list(range(len(lines)))
        for a in range(len(lines)):
            for b in range(a):
                if shares[a, b] and linededup.similar(lines[a], lines[b], 0.8):
                    u, v = sorted((told[a], told[b]))
                    told = [u if x == v else x for x in told]
        assert seed.tolist() == told
    pairs = [(x, y) for lines in sets[:150] for x in lines for y in lines]
    assert linededup.distances(pairs).tolist() == [linededup.distance(a, b, 10**9) for a, b in pairs]


def test_parcels_meet_as_single_pairs_do(spark):
    rng = np.random.default_rng(11)
    top = np.uint64(1 << 63)
    bucket = np.concatenate((rng.integers(0, 2**63, 3000).astype(np.uint64), top + rng.integers(0, 500, 4000).astype(np.uint64), np.full(2500, 7, np.uint64)))
    h = rng.integers(-1500, 1500, len(bucket))
    part, parcel = groups.parcels(bucket, h)
    assert len(parcel) < 3000 + 8 + 5 and max(map(len, parcel.to_pylist())) <= 16 * groups.PARCEL
    single = spark.createDataFrame(list(zip(bucket.view(np.int64).tolist(), h.tolist(), strict=True)), "bucket long, h long")
    packed = spark.createDataFrame(list(zip(part.to_pylist(), parcel.to_pylist(), strict=True)), "part int, parcel binary")
    want = sorted(map(tuple, groups.met(single).collect()))
    assert want and sorted(map(tuple, groups.met_parcels(packed).collect())) == want
    # one part beyond what is put in order at once
    n = 2 * groups.AT_ONCE + 5
    many = np.arange(n, dtype=np.uint64) // np.uint64(2) * np.uint64(977)
    part, parcel = groups.parcels(many, np.arange(n))
    table = spark.createDataFrame(list(zip(part.to_pylist(), parcel.to_pylist(), strict=True)), "part int, parcel binary")
    out = groups.met_parcels(table).toPandas()
    assert len(out) == n - 1 and set(out["h"]) == set(range(n - 1)) and (out["root"] == out["h"] // 2 * 2).all()


def test_fuzzy_lines_meet_whatever_the_keys(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    long = [word() for _ in range(60)]
    texts = [" ".join(long) + "\nalone one", "other words here\n" + " ".join([*long[:30], "changed", *long[31:]]), " ".join([*long[:10], *long[12:]]), "x" * 5000 + "\n" + "x" * 4990]
    for keys in ([1, 2, 3, 4], [1, 1, 1, 1], [None] * 4):
        table = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
        out = linededup.line_groups(table).collect()
        assert len(out) == 6 + 1 and len({r["group"] for r in out}) == 4 - 0


def test_changed_words_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    for size, changes, least in ((25, 1, 0.99), (60, 1, 0.99), (25, 3, 0.9), (8, 1, 0.7)):
        rows = []
        for k in range(100):
            words = [word() for _ in range(size)]
            rows.append((2 * k, " ".join(words)))
            for at in rng.sample(range(size), changes):
                words[at] = words[at][:-1] + "zz"
            rows.append((2 * k + 1, " ".join(words)))
        out = {r["doc_id"]: r["group"] for r in linededup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(out[2 * k] == out[2 * k + 1] for k in range(100)) / 100 >= least


def test_large_sets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(7)
    points = rng.integers(0, 3000, 700)
    rows = [(int(h) % 3, int(h), str(x)) for h, x in enumerate(points)]
    near = lambda items, at, rest: rest[np.abs(items[rest] - items[at]) <= 3]
    prepare = lambda payload: np.array(payload, np.int64)
    want = {}
    for root in range(3):
        ids = [h for r, h, _ in rows if r == root]
        label = settled(np.abs(points[ids][:, None] - points[ids][None, :]) <= 3)
        want |= {h: ids[k] for h, k in zip(ids, label, strict=True)}
    for most in (10_000, 25):
        found = groups.linked(spark.createDataFrame(rows, "root long, h long, payload string"), prepare, near, most=most)
        roots = {r["node"]: r["root"] for r in components.components(found).collect()}
        assert {h: roots.get(h, h) for h in want} == want


def test_katz_against_plain_counts(spark, docs, odd, empty):
    from math import log10

    rows = {r["doc_id"]: r for r in katz.score_documents(docs).collect()}
    tokens = {r["doc_id"]: [*r["text"].encode().lower().split(), b""] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    one, two = Counter(), Counter()
    for k, w in tokens.items():
        if not held[k]:
            one.update(w)
            two.update(zip([b"", *w[:-1]], w, strict=True))
    total, size = sum(one.values()), len(one)
    d1, d2 = katz.discounts(Counter(one.values())), katz.discounts(Counter(two.values()))
    chance = {w: d1[min(c, katz.TOP + 1)] * c / total for w, c in one.items()}
    left = 1 - sum(chance.values())
    after = {}
    for (h, w), c in two.items():
        after.setdefault(h, []).append((w, c))

    def weights(h):
        if h not in after:
            return 1.0, 1
        freed = sum(c * (1 - d2[min(c, katz.TOP + 1)]) for _, c in after[h])
        bottom = one[h] + (freed <= 0)
        return (freed if freed > 0 else 1.0) / bottom / (1 - sum(chance[w] for w, _ in after[h])), bottom

    known = {h: weights(h) for h in [*after, None]}
    for h in list(after)[:20]:
        alpha, bottom = known[h]
        seen = sum(d2[min(c, katz.TOP + 1)] * c / bottom for _, c in after[h])
        assert abs(seen + alpha * (left + sum(p for w, p in chance.items() if (h, w) not in two)) - 1) < 1e-9
    for k, w in tokens.items():
        score = base = 0.0
        for h, x in zip([b"", *w[:-1]], w, strict=True):
            alpha, bottom = known.get(h, known[None])
            c = two[h, x]
            score += log10(d2[min(c, katz.TOP + 1)] * c / bottom) if c else log10(alpha * chance.get(x, left))
            base += log10((one[x] + 1) / (total + size + 1))
        r = rows[k]
        assert abs(r["score"] - score) < 1e-6 * abs(score) and abs(r["base_score"] - base) < 1e-6 * abs(base)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(w), sum(one[x] > 0 for x in w), total)
    assert sum(r["score"] for r in rows.values() if r["held_out"]) > sum(r["base_score"] for r in rows.values() if r["held_out"])
    strange = katz.score_documents(odd).collect()
    assert len(strange) == 8 and all(np.isfinite(r["score"]) for r in strange) and {r["n_tokens"] for r in strange if r["doc_id"] in (2, 3, 5)} == {1}
    assert katz.score_documents(empty).count() == 0


def test_mixing_fits_scarce_and_soft_domains(spark):
    rng = np.random.default_rng(5)

    def fitted(posterior, tokens, targets, **limits):
        table = spark.createDataFrame([(int(n), [float(x) for x in p]) for n, p in zip(tokens, posterior, strict=True)], "tokens long, posterior array<double>")
        return mixing.fit(table, targets, sorted(targets), **limits)

    hard = np.array([[1.0, 0.0]] * 999 + [[0.0, 1.0]])
    plan = fitted(hard, [100] * 999 + [10], {"a": 1, "b": 1})
    assert np.abs(plan.reached - plan.target).max() <= 1e-3 * plan.target.sum()
    soft = rng.dirichlet([2, 1, 1, 3], 400) * 0.6 + 0.1
    tokens = rng.integers(1, 500, 400)
    plan = fitted(soft, tokens, {"a": 0.3, "b": 0.25, "c": 0.25, "d": 0.2})
    assert np.abs(plan.reached - plan.target).max() <= 1e-3 * plan.target.sum()
    rate = mixing.rates_of(soft, plan.steps, 0.0, np.inf)
    assert (rate >= 0).all() and np.allclose((rate * tokens) @ soft, plan.reached)
    # a target that no non-negative rates reach ends nearer than rates of 1, without an error
    plan = fitted(soft, tokens, {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0})
    assert np.linalg.norm(plan.target - plan.reached) < 0.8 * np.linalg.norm(plan.target - tokens @ soft)


def test_mixing_reaches_its_targets(spark, docs, odd, empty):
    targets = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    labelled = docs.select("text", F.col("lang").alias("domain"))
    rated, plan = mixing.mixture(docs, labelled, targets)
    rows = rated.collect()
    assert len(rows) == docs.count() and all(r["rate"] >= 0 for r in rows)
    share = sum(np.array(r["posterior"]) * r["rate"] * r["tokens"] for r in rows)
    assert np.abs(share / share.sum() - np.array([targets[d] for d in plan.domains])).max() < 0.01
    mixed = mixing.mix(docs, labelled, targets)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == docs.count() < mixed.count()
    assert mixing.mixture(odd, labelled, targets)[0].count() == 8 and mixing.mix(odd, labelled, targets).count() >= 8
    assert mixing.mixture(empty, labelled, targets)[0].count() == 0 and mixing.mixture(docs, labelled.limit(0), targets)[0].count() == docs.count()
