"""Rules on literal rows, among them those that the generated tables never hit."""

from pyspark.sql import functions as F

from quern.functions.text import casefold, exact_hash
from quern.operators import enrich, export, filters, normalize
from quern.operators.dedup import PRIME, permuted


def rows(spark, *texts, **more):
    return spark.createDataFrame([(k, t, more.get("source", "s"), more.get("lang", "en")) for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")


def test_normalizer_steps(spark):
    raw = "﻿Tom &amp; Jerry\r\nsaid  “hi” — twice… café zero​width mail a.b@c.org \x07 end" + " padding" * 5
    out = normalize.normalize(rows(spark, raw, "short", None)).orderBy("doc_id").collect()
    assert out[0]["text"].startswith('Tom & Jerry\nsaid "hi" -- twice... café zerowidth mail __EMAIL__ end')
    assert out[0]["normalize_rule"] is None and out[0]["char_count"] == len(out[0]["text"])
    assert out[1]["normalize_rule"] == "too_short_after_normalisation" and out[1]["text"] == "short"
    assert out[2]["normalize_rule"] == "too_short_after_normalisation"


def test_normalizer_is_idempotent(spark):
    once = normalize.normalize(rows(spark, "  A\t\tb\n\n\n\nc " + "word " * 20))
    assert once.select("text").collect() == normalize.normalize(once.select("doc_id", "text")).select("text").collect()


def test_safety_cascade(spark):
    texts = ["jailbreak and ignore previous instructions", "a clean sentence about rivers", "casino casino casino", "eval(base64_decode(x))", "card 1234567890123456", "as an AI language model", "exterminate"]
    found = [r["safety_rule"] for r in filters.safety_gate(rows(spark, *texts)).orderBy("doc_id").collect()]
    assert found == ["prompt_injection", None, "spam_density", "malware_signature", "exposed_pii", "synthetic_content_marker", "hate_speech_keyword"]
    strict = filters.safety_gate(rows(spark, "you are now here"), max_injection=0).first()
    assert strict["safety_rule"] == "prompt_injection"


def test_language_scripts_and_overrides(spark):
    docs = rows(spark, "plain english words", "这是一个中文句子这是一个中文句子", "это русское предложение", "هذه جملة عربية", "12345 67890")
    out = [(r["language"], r["lang_confidence"]) for r in filters.language_gate(docs).orderBy("doc_id").collect()]
    assert out == [("en", 0.7), ("zh", 0.8), ("ru", 0.75), ("ar", 0.75), ("en", 0.5)]
    free = filters.language_gate(docs, overrides={"s": ["*"]}).filter("language_rule IS NOT NULL").count()
    assert free == 0
    own = filters.language_gate(docs, overrides={"s": ["zh"]}, min_confidence=0.6).orderBy("doc_id").collect()
    assert [r["language_rule"] for r in own] == ["language_not_target", None, "language_not_target", "language_not_target", "lang_confidence_too_low"]


def test_quality_gate(spark):
    good = "The analysis of rivers shows that water flows downhill because gravity acts on it. " * 3 + "However, research suggests that valleys form slowly over many thousands of years."
    out = filters.quality_gate(rows(spark, good, "two words", "LOUD WORDS " * 15, "", None)).orderBy("doc_id").collect()
    assert out[1]["quality_rule"] == "too_few_words" and out[2]["quality_rule"] == "high_uppercase" and out[3]["quality_rule"] == "too_few_words"
    assert 0 < out[0]["overall_quality"] <= 1 and out[0]["n_repeated"] > 0


def test_hash_and_casefold(spark):
    out = spark.createDataFrame([("  Straße\n x ",), ("straße X",)], "t string").select(exact_hash(F.col("t")).alias("h"), casefold(F.col("t")).alias("c")).collect()
    assert out[0]["h"] == out[1]["h"] and out[1]["c"] == "strasse x"


def test_wikitext_posts_books(spark):
    text = "<!-- x -->'''A''' {{b|{{c}}}}<ref name=q>z</ref> [[Link|label]] [[File:p.png|thumb]]\n== Head ==\nend"
    book = "intro\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody text\n*** END OF THE PROJECT GUTENBERG EBOOK"
    post = "<p>a &lt; b</p><code> x = 1 </code>"
    row = spark.createDataFrame([(text, book, post)], "w string, b string, p string").select(enrich.wikitext(F.col("w")).alias("w"), enrich.book_text(F.col("b")).alias("b"), enrich.post_body(F.col("p")).alias("p")).first()
    assert "label" in row["w"] and "Head" not in row["w"] and "ref" not in row["w"] and "File" not in row["w"]
    assert row["b"] == "body text" and "```\nx = 1\n```" in row["p"]


def test_line_cleaner(spark):
    lines = ["== Heading ==", "| table row", "Category: x", "#redirect y", "A good line about [[the sea|seas]] and its waves.[3]", "a good line about seas and its waves.", "tiny", "ALL CAPITALS IN THIS LONG LINE HERE", "aaaaaa repeated characters in a line", ""]
    out = [r["line"] for r in enrich.clean_lines(enrich.explode_lines(rows(spark, "\n".join(lines)))).collect()]
    assert out == ["A good line about seas and its waves."]


def test_log_lines_and_intent(spark):
    told = spark.createDataFrame([("2024-01-02 03:04:05 | WARNING | core.x | disk is full",), ("free text",)], "l string").select(enrich.log_fields(F.col("l")).alias("x")).select("x.*").collect()
    assert tuple(told[0]) == ("2024-01-02 03:04:05", "WARNING", "core.x", "disk is full") and told[1]["level"] == "INFO" and told[1]["msg"] == "free text"
    asked = spark.createDataFrame([("Who is Ada",), ("latest price of tea",), ("explain rivers",)], "q string").select(enrich.needs_search(F.col("q")).alias("x")).select("x.why").collect()
    assert [r[0] for r in asked] == ["short_factual", "live_signal", "static_knowledge"]


def test_enricher(spark):
    out = enrich.enrich(rows(spark, "Machine learning uses data and algorithms. Students study it at university. It is software.")).first()
    assert out["topics"] and out["sentence_count"] == 3 and 0 <= out["reading_grade"] <= 20


def test_minhash_arithmetic(spark):
    s = [0, 1, 2**32 - 1, 123456789]
    for a, b in ((1, 0), (PRIME - 1, PRIME - 1), (987654321987654321 % PRIME, 1234567890123)):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in s], "s long").select(permuted(F.col("s"), a, b)).collect()]
        assert got == [((a * x + b) % PRIME) & 0xFFFFFFFF for x in s]


def test_shards_quota_natural_order(spark):
    docs = spark.createDataFrame([("a", k, 100) for k in range(7)], "source string, k long, n long")
    shards = [r["shard"] for r in export.shard_ids(docs, "source", "k", "n", 3, 1024).orderBy("k").collect()]
    assert shards == [0, 0, 0, 1, 1, 1, 2]
    after = [r["shard"] for r in export.shard_ids(docs, "source", "k", "n", 10**6, 250, after=True).orderBy("k").collect()]
    assert after == [0, 0, 0, 1, 1, 1, 2]
    quotas = spark.createDataFrame([("a", 150)], "source string, max_bytes long")
    admitted = [r["admitted"] for r in export.quota_admission(docs, "source", "k", "n", quotas).orderBy("k").collect()]
    assert admitted == [True, True] + [False] * 5
    names = spark.createDataFrame([(f"wk_{n}.txt",) for n in (0, 1, 10, 100, 2, 20, 9, 11)], "name string")
    assert [r[0] for r in export.natural_order(names, "name").collect()] == [f"wk_{n}.txt" for n in (0, 1, 2, 9, 10, 11, 20, 100)]
