"""The registry of the core queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quern.functions import rules
from quern.functions.text import exact_hash, preview, words
from quern.operators import dedup, enrich, export, filters, metrics, normalize, prep, tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return put


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def hits(pattern: str, text: str = "text", flags: str = "") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}, 0, '{flags}'))" if flags else f"len(regexp_extract_all({text}, {quoted(pattern)}))"


CLEAN = f"""SELECT doc_id, lang, source, text AS raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(replace(translate(regexp_replace(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), {quoted(rules.CONTROL)}, '', 'g'),
    {quoted(rules.QUOTES_FROM)}, {quoted(rules.QUOTES_TO)}), '—', '--'), '…', '...'),
    {quoted(rules.EMAIL)}, ' __EMAIL__ ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents"""
NORMAL = f"""SELECT doc_id, lang, source, CASE WHEN length(t) < 50 THEN raw ELSE t END AS text, CASE WHEN length(t) < 50 THEN 'too_short_after_normalisation' END AS normalize_rule FROM ({CLEAN})"""


@query("normalize_documents", f"""SELECT doc_id, text, CAST(length(text) AS BIGINT) AS char_count, CAST({hits(chr(92) + 'S+')} AS BIGINT) AS word_count,
    CAST(length(text) // 4 AS BIGINT) AS token_estimate, normalize_rule FROM ({NORMAL})""")
def normalize_documents(spark, sf_dir):
    return normalize.normalize(table(spark, sf_dir, "documents")).select("doc_id", "text", "char_count", "word_count", "token_estimate", "normalize_rule")


@query("language_script_filter", """WITH h AS (SELECT doc_id, greatest(length(substr(text, 1, 300)), 1) AS n, len(regexp_extract_all(substr(text, 1, 300), '\\p{Latin}')) AS l FROM documents)
    SELECT doc_id, 'en' AS language, CASE WHEN l / n > 0.60::DOUBLE THEN 0.70::DOUBLE ELSE 0.50::DOUBLE END AS lang_confidence, 'lang_confidence_too_low' AS strict_rule,
    CASE WHEN l / n > 0.60::DOUBLE THEN NULL ELSE 'lang_confidence_too_low' END AS relaxed_rule FROM h""")
def language_script_filter(spark, sf_dir):
    """The script detector under the strict confidence (0.80) and the shipped one (0.60)."""
    docs = table(spark, sf_dir, "documents")
    strict = filters.language_gate(docs).withColumnRenamed("language_rule", "strict_rule").drop("language", "lang_confidence")
    return filters.language_gate(strict, min_confidence=0.60).select("doc_id", "language", "lang_confidence", "strict_rule", F.col("language_rule").alias("relaxed_rule"))


@query("safety_rule_cascade", f"""WITH c AS (SELECT doc_id, text, {hits(rules.SPAM, flags='i')} AS s, {hits(rules.INJECTION, flags='i')} AS i, greatest({hits(chr(92) + 'S+')}, 1) AS n FROM documents)
    SELECT doc_id, CAST(s AS INTEGER) AS spam_hits, CAST(i AS INTEGER) AS injection_hits, CASE
    WHEN regexp_matches(text, {quoted(rules.HATE)}, 'i') THEN 'hate_speech_keyword' WHEN regexp_matches(text, {quoted(rules.EXPLICIT)}, 'i') THEN 'explicit_content_keyword'
    WHEN s / (n / 100) > 3.0::DOUBLE THEN 'spam_density' WHEN i > 1 THEN 'prompt_injection' WHEN regexp_matches(text, {quoted(rules.MALWARE)}, 'i') THEN 'malware_signature'
    WHEN regexp_matches(text, {quoted(rules.PII)}, 'i') THEN 'exposed_pii' WHEN regexp_matches(text, {quoted(rules.SYNTHETIC)}, 'i') THEN 'synthetic_content_marker' END AS safety_rule FROM c""")
def safety_rule_cascade(spark, sf_dir):
    return filters.safety_gate(table(spark, sf_dir, "documents")).select("doc_id", "spam_hits", "injection_hits", "safety_rule")


def signals_sql(source: str) -> str:
    edu = "[" + ", ".join(map(quoted, rules.EDUCATIONAL)) + "]"
    return f"""WITH w AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM ({source})),
    g AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, least(len(w), 500) - 1), lambda i: w[i] || chr(1) || w[i+1] || chr(1) || w[i+2]) ELSE [] END AS g,
        list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(trim(p)) > 0) AS p FROM w),
    c AS (SELECT * EXCLUDE (w, g, p), length(text) AS n_chars_all, {hits(chr(92) + 'p{L}')} AS n_alpha, {hits(chr(92) + 'p{Nd}')} AS n_digit, {hits(chr(92) + 'p{Lu}')} AS n_upper, len(w) AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_unique, {hits('[.!?]' + chr(92) + 's+')} + 1 AS n_sentences,
        len(p) AS n_paragraphs, len(list_filter(p, lambda q: len(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '')) >= 10)) AS n_long_paragraphs, len(g) AS n_grams, len(g) - len(list_distinct(g)) AS n_repeated,
        {hits(rules.BOILERPLATE, flags='i')} AS n_boilerplate, coalesce(list_sum(list_transform(regexp_extract_all(text, {quoted(rules.MARKUP)}), lambda x: length(x))), 0) AS markup_chars,
        {hits('https?://', flags='i')} AS n_urls, len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), {edu})) AS n_educational, {hits('[.,;:!?]')} AS n_punctuation FROM g),
    r AS (SELECT *, n_alpha / greatest(n_chars_all, 1) AS alpha_ratio, n_digit / greatest(n_chars_all, 1) AS digit_ratio, n_upper / greatest(n_alpha, 1) AS upper_ratio, word_chars / greatest(n_words, 1) AS mean_word_length,
        n_unique / greatest(n_words, 1) AS unique_ratio, n_long_paragraphs / greatest(n_paragraphs, 1) AS paragraph_ratio, n_repeated / greatest(n_grams, 1) AS repetition_ratio,
        least(n_boilerplate / n_sentences, 1.0::DOUBLE) AS boilerplate_ratio, markup_chars / greatest(n_chars_all, 1) AS markup_ratio, n_urls / (greatest(n_words, 1) / 100) AS url_density,
        least(n_educational / greatest(n_words, 1) * 10, 1.0::DOUBLE) AS educational_density, least(n_punctuation / n_sentences, 1.0::DOUBLE) AS punctuation_ok FROM c)
    SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.0::DOUBLE + 0.15::DOUBLE * least(alpha_ratio / 0.5::DOUBLE, 1.0::DOUBLE) + 0.10::DOUBLE * least(unique_ratio / 0.25::DOUBLE, 1.0::DOUBLE) + 0.15::DOUBLE * educational_density
        + 0.10::DOUBLE * paragraph_ratio + 0.10::DOUBLE * CASE WHEN mean_word_length BETWEEN 3.0::DOUBLE AND 15.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + 0.05::DOUBLE * punctuation_ok + -0.20::DOUBLE * repetition_ratio
        + -0.15::DOUBLE * markup_ratio + -0.10::DOUBLE * boilerplate_ratio + -0.05::DOUBLE * upper_ratio + -0.05::DOUBLE * least(url_density / 5.0::DOUBLE, 1.0::DOUBLE) + 0.5::DOUBLE)) AS overall_quality FROM r"""


COUNTS = ("n_alpha", "n_digit", "n_upper", "n_words", "word_chars", "n_unique", "n_sentences", "n_paragraphs", "n_long_paragraphs", "n_grams", "n_repeated", "n_boilerplate", "markup_chars", "n_urls", "n_educational", "n_punctuation")
GATE = """CASE WHEN n_words < 20 THEN 'too_few_words' WHEN round(alpha_ratio, 4) < 0.5::DOUBLE THEN 'low_alpha' WHEN round(digit_ratio, 4) > 0.3::DOUBLE THEN 'high_digit' WHEN round(upper_ratio, 4) > 0.2::DOUBLE THEN 'high_uppercase'
    WHEN repetition_ratio > 0.25::DOUBLE THEN 'high_repetition' WHEN boilerplate_ratio > 0.15::DOUBLE THEN 'high_boilerplate' WHEN markup_ratio > 0.05::DOUBLE THEN 'high_markup' WHEN round(overall_quality, 4) < 0.35::DOUBLE THEN 'low_quality' END"""


@query("quality_signals", f"SELECT doc_id, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in COUNTS)}, overall_quality FROM ({signals_sql('SELECT doc_id, text FROM documents')})")
def quality_signals(spark, sf_dir):
    return filters.quality_signals(table(spark, sf_dir, "documents")).select("doc_id", *[F.col(c).cast("int").alias(c) for c in COUNTS], "overall_quality")


@query("quality_gate", f"SELECT doc_id, {GATE} AS quality_rule FROM ({signals_sql('SELECT doc_id, text FROM documents')})")
def quality_gate(spark, sf_dir):
    return filters.quality_gate(table(spark, sf_dir, "documents")).select("doc_id", "quality_rule")


HASHED = "SELECT *, sha256(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS exact_hash FROM documents"


@query("exact_hash_dedup", f"SELECT doc_id, exact_hash, doc_id <> min(doc_id) OVER (PARTITION BY exact_hash) AS is_duplicate FROM ({HASHED})")
def exact_hash_dedup(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "exact_hash", "is_duplicate")


@query("exact_dedup_stats", f"SELECT count(*) AS total, count(*) - count(DISTINCT exact_hash) AS exact_removed, count(DISTINCT exact_hash) AS unique_kept FROM ({HASHED})")
def exact_dedup_stats(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents")).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_duplicate").alias("exact_removed"), F.count_if(~F.col("is_duplicate")).alias("unique_kept"))


TOKENS = "regexp_extract_all(lower(substr(text, 1, 2000)), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')"
PRINTS = f"""(WITH t AS (SELECT doc_id, lower(substr(text, 1, 2000)) AS low, {TOKENS} AS t FROM documents),
    g AS (SELECT doc_id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i+1] || t[i+2]) WHEN len(t) > 0 THEN t ELSE [substr(low, 1, 32)] END) AS g FROM t),
    h AS (SELECT doc_id, CAST('0x' || substr(md5(g), 17, 16) AS UBIGINT) AS h FROM g),
    v AS (SELECT doc_id, {", ".join(f"sum(2 * CAST((h >> {i}) & 1 AS INTEGER) - 1) AS b{i}" for i in range(64))} FROM h GROUP BY doc_id)
    SELECT doc_id, CAST({" + ".join(f"CASE WHEN b{i} > 0 THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(63))} - CASE WHEN b63 > 0 THEN {1 << 63}::HUGEINT ELSE 0 END AS BIGINT) AS simhash FROM v)"""


@query("simhash_fingerprint", f"SELECT doc_id, simhash FROM {PRINTS}")
def simhash_fingerprint(spark, sf_dir):
    return dedup.simhash(table(spark, sf_dir, "documents"))


@query("simhash_pairs", f"""WITH n AS (SELECT simhash, min(doc_id) AS k FROM {PRINTS} GROUP BY simhash)
    SELECT a.k AS a, b.k AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM n a JOIN n b ON a.k < b.k AND bit_count(xor(a.simhash, b.simhash)) <= 10""")
def simhash_pairs(spark, sf_dir):
    """All pairs of distinct fingerprints within 10 bits."""
    return dedup.hamming_pairs(dedup.simhash(table(spark, sf_dir, "documents")), radius=10)


@query("near_dup_survivors")
def near_dup_survivors(spark, sf_dir):
    """Exact, then greedy SimHash de-duplication within 3 bits, in document order."""
    return dedup.near_dup_survivors(table(spark, sf_dir, "documents"), radius=3)


def minhash_sql() -> str:
    values = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(dedup.permutations()))
    return f"""WITH t AS (SELECT doc_id, lower(substr(text, 1, 2000)) AS low, {TOKENS} AS t FROM documents),
    s AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(g), 25, 8) AS UBIGINT)::HUGEINT AS s FROM (SELECT doc_id, unnest(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || t[i+1]) ELSE [substr(low, 1, 64)] END) AS g FROM t)),
    p(i, a, b) AS (VALUES {values}),
    m AS (SELECT doc_id, i, min(CAST(((a * s + b) % {dedup.PRIME}) % 4294967296 AS BIGINT)) AS v FROM s, p GROUP BY doc_id, i),
    g AS (SELECT doc_id, list(v ORDER BY i) AS sig FROM m GROUP BY doc_id), n AS (SELECT sig, min(doc_id) AS k FROM g GROUP BY sig),
    b AS (SELECT k, sig, unnest(range(20)) AS i FROM n), c AS (SELECT k, sig, i, sig[i * 5 + 1 : i * 5 + 5] AS v FROM b)
    SELECT DISTINCT x.k AS a, y.k AS b, CAST(len(list_filter(range(1, 129), lambda j: x.sig[j] = y.sig[j])) AS INTEGER) AS equal FROM c x JOIN c y ON x.i = y.i AND x.v = y.v AND x.k < y.k
    WHERE len(list_filter(range(1, 129), lambda j: x.sig[j] = y.sig[j])) >= 128 * 0.8"""


@query("minhash_lsh_pairs", minhash_sql())
def minhash_lsh_pairs(spark, sf_dir):
    return dedup.minhash_pairs(dedup.minhash(table(spark, sf_dir, "documents")))


def topics_sql() -> str:
    each = ", ".join("{'s': -(" + " + ".join(f"contains(lower(text), {quoted(k)})::INTEGER" for k in keys) + f"), 'r': {r}, 't': {quoted(name)}}}" for r, (name, keys) in enumerate(rules.TOPICS.items()))
    return f"list_transform(list_slice(list_sort(list_filter([{each}], lambda x: x.s < 0)), 1, 3), lambda x: x.t)"


ENRICHED = f"""(WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, {topics_sql()} AS topics FROM documents),
    c AS (SELECT doc_id, greatest(1, length(text) // 4) AS token_estimate, topics, len(w) AS n_words, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: length(trim(s)) > 0)) AS sentence_count,
    coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouAEIOU]+'))))), 0) AS syllables, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(trim(p)) > 0)) AS paragraph_count,
    {hits('```')} AS code_block_count, regexp_matches(text, '(?m)^\\s*[-*•]\\s') AS has_lists FROM w)
    SELECT *, greatest(0.0::DOUBLE, least(20.0::DOUBLE, 0.39::DOUBLE * (greatest(n_words, 1) / greatest(sentence_count, 1)) + 11.8::DOUBLE * (syllables / greatest(n_words, 1)) - 15.59::DOUBLE)) AS reading_grade FROM c)"""


@query("metadata_enrichment", f"""SELECT doc_id, CAST(token_estimate AS INTEGER) AS token_estimate, array_to_string(topics, ',') AS topics, CAST(sentence_count AS INTEGER) AS sentence_count, CAST(syllables AS INTEGER) AS syllables,
    CAST(paragraph_count AS INTEGER) AS paragraph_count, CAST(code_block_count AS INTEGER) AS code_block_count, has_lists, reading_grade FROM {ENRICHED}""")
def metadata_enrichment(spark, sf_dir):
    out = enrich.enrich(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "token_estimate", F.array_join("topics", ",").alias("topics"), "sentence_count", "syllables", "paragraph_count", "code_block_count", "has_lists", "reading_grade")


@query("topic_histogram", f"SELECT topic, count(*) AS docs FROM (SELECT unnest(topics) AS topic FROM {ENRICHED}) GROUP BY topic")
def topic_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(enrich.topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("docs"))


def funnel(docs: DataFrame) -> DataFrame:
    """Every document with the first rule of the chain that it breaks: length, quality, exact copies of what is left."""
    done = normalize.normalize(docs)
    rated = filters.quality_gate(done).select("doc_id", "lang", "source", F.coalesce("normalize_rule", "quality_rule").alias("rule"), exact_hash(F.col("text")).alias("exact_hash"))
    # the few short columns are kept: read twice below, and no filter on a rule is pushed into the texts again
    rated = rated.persist(StorageLevel.MEMORY_AND_DISK)
    first = rated.filter("rule IS NULL").groupBy("exact_hash").agg(F.min("doc_id").alias("first"))
    met = rated.join(first, "exact_hash", "left")
    return met.withColumn("rule", F.coalesce("rule", F.when(F.col("doc_id") != F.col("first"), F.lit("exact_duplicate")))).drop("first")


FUNNEL = f"""(WITH q AS ({signals_sql(NORMAL)}), r AS (SELECT doc_id, lang, source, text, coalesce(normalize_rule, {GATE}) AS rule, sha256(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS h FROM q)
    SELECT doc_id, lang, source, text, coalesce(rule, CASE WHEN doc_id <> min(CASE WHEN rule IS NULL THEN doc_id END) OVER (PARTITION BY h) THEN 'exact_duplicate' END) AS rule FROM r)"""
STEPS = ("too_short_after_normalisation", "too_few_words", "low_alpha", "high_digit", "high_uppercase", "high_repetition", "high_boilerplate", "high_markup", "low_quality", "exact_duplicate")


@query("pipeline_funnel", f"SELECT lang, count(*) AS docs_in, {', '.join(f'''count(*) FILTER (rule = '{s}') AS {s}''' for s in STEPS)}, count(*) FILTER (rule IS NULL) AS kept FROM {FUNNEL} GROUP BY lang")
def pipeline_funnel(spark, sf_dir):
    """Rejections by rule and language of the chain normalise, quality, exact copies."""
    return funnel(table(spark, sf_dir, "documents")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs_in"), *[F.count_if(F.col("rule") == s).alias(s) for s in STEPS], F.count_if(F.col("rule").isNull()).alias("kept"))


@query("source_summary_rollup", f"SELECT source, count(*) AS total_raw, count(*) FILTER (rule IS NULL) AS total_accepted, count(*) FILTER (rule IS NOT NULL) AS total_rejected FROM {FUNNEL} GROUP BY ROLLUP (source)")
def source_summary_rollup(spark, sf_dir):
    return funnel(table(spark, sf_dir, "documents")).rollup("source").agg(F.count(F.lit(1)).alias("total_raw"), F.count_if(F.col("rule").isNull()).alias("total_accepted"), F.count_if(F.col("rule").isNotNull()).alias("total_rejected"))


@query("quality_vs_labels", f"SELECT quality, toxic, rule IS NULL AS accepted, count(*) AS docs FROM {FUNNEL} JOIN labels USING (doc_id) GROUP BY ALL")
def quality_vs_labels(spark, sf_dir):
    met = funnel(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id")
    return met.groupBy("quality", "toxic", F.col("rule").isNull().alias("accepted")).agg(F.count(F.lit(1)).alias("docs"))


def lines_sql() -> str:
    line = "regexp_replace(l, '^\\s+|\\s+$', '', 'g')"
    bare = line
    for pattern, new in rules.LINE_MARKUP:
        flags = "g"
        if pattern.startswith("(?is)"):
            pattern, flags = pattern[5:], "gis"
        line = f"regexp_replace({line}, {quoted(pattern)}, {quoted(new.replace('$1', chr(92) + '1'))}, '{flags}')"
    structural = " OR ".join(f"regexp_matches({bare}, {quoted(p)})" for p in rules.STRUCTURAL)
    return f"""(WITH x AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents), u AS (SELECT doc_id, source, unnest(p) AS l, unnest(range(len(p))) AS line_no FROM x),
    s AS (SELECT doc_id, source, line_no, regexp_replace({line}, '^\\s+|\\s+$', '', 'g') AS line FROM u WHERE length({bare}) > 0 AND NOT ({structural})),
    q AS (SELECT *, {hits(chr(92) + 'p{L}', 'line')} AS al, length(line) AS n FROM s),
    k AS (SELECT * FROM q WHERE n BETWEEN 20 AND 2000 AND al / n >= 0.5::DOUBLE AND {hits('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]', 'line')} / n <= 0.25::DOUBLE AND {hits(chr(92) + 'p{Nd}', 'line')} / n <= 0.3::DOUBLE
        AND NOT (line = upper(line) AND al > 5) AND len(list_filter(range(1, n - 3), lambda i: substr(line, i, 5) = repeat(substr(line, i, 1), 5))) = 0)
    SELECT doc_id, source, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, replace(lower(line), 'ß', 'ss') ORDER BY line_no) AS rn FROM k) WHERE rn = 1)"""


@query("line_clean", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM {lines_sql()}")
def line_clean(spark, sf_dir):
    return enrich.clean_lines(enrich.explode_lines(table(spark, sf_dir, "documents"))).select("doc_id", "line_no", "line")


@query("cleaning_summary", f"""SELECT d.source, CAST(sum(d.raw) AS BIGINT) AS raw_lines, CAST(sum(coalesce(c.cleaned, 0)) AS BIGINT) AS cleaned_lines FROM (SELECT doc_id, source, len(string_split(text, chr(10))) AS raw FROM documents) d
    LEFT JOIN (SELECT doc_id, count(*) AS cleaned FROM {lines_sql()} GROUP BY doc_id) c USING (doc_id) GROUP BY ROLLUP (d.source)""")
def cleaning_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    kept = enrich.clean_lines(lines).groupBy("source").agg(F.count(F.lit(1)).alias("cleaned_lines")).select("source", F.lit(0).alias("raw_lines"), "cleaned_lines")
    raw = docs.select("source", F.size(F.split("text", "\n")).alias("raw_lines"), F.lit(0).cast("long").alias("cleaned_lines"))
    return raw.union(kept).rollup("source").agg(F.sum("raw_lines").alias("raw_lines"), F.sum("cleaned_lines").alias("cleaned_lines"))


def html_sql(tags: tuple[str, ...]) -> str:
    out = "html"
    for tag in tags:
        out = f"regexp_replace({out}, '<{tag}\\b.*?</{tag}>', ' ', 'gis')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("html_to_text", f"SELECT page_id, {html_sql(('script', 'style', 'nav', 'footer', 'header', 'aside'))} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", enrich.html_text(F.col("html")).alias("text"))


@query("web_page_text", "SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 3000) AS text FROM pages")
def web_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", enrich.fetched_text(F.col("html")).alias("text"))


@query("host_dedup", "SELECT host, min(page_id) AS page_id, count(*) AS pages FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages) GROUP BY host")
def host_dedup(spark, sf_dir):
    """The first page of each host; only keys are compared, so a hot host combines before the shuffle."""
    pages = table(spark, sf_dir, "pages").withColumn("host", enrich.netloc(F.col("url")))
    return pages.groupBy("host").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("pages"))


BLOCKED = ("spam-farm.example.org", "www.cheap-pills.example.com")


@query("host_blocklist", f"SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages WHERE regexp_extract(url, 'https?://([^/]+)', 1) NOT IN {BLOCKED}")
def host_blocklist(spark, sf_dir):
    blocked = spark.createDataFrame([(h,) for h in BLOCKED], "host string")
    return table(spark, sf_dir, "pages").select("page_id", enrich.host(F.col("url")).alias("host")).join(blocked, "host", "left_anti").select("page_id", "host")


@query("export_plain_text", "SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS line FROM documents")
def export_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", export.plain_text(F.col("text")).alias("line"))


@query("export_jsonl_text_only", "SELECT doc_id, CAST(to_json({'text': text}) AS VARCHAR) AS line FROM documents")
def export_jsonl_text_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", export.json_text(F.col("text")).alias("line"))


@query("export_jsonl_sft", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || chr(10) || 'Answer: yes ' ELSE text END AS t FROM documents), e AS (SELECT *, instr(t, chr(10) || chr(10) || 'Answer:') AS a FROM d)
    SELECT doc_id, CASE WHEN a > 0 THEN regexp_replace(substr(t, 1, a - 1), '^\\s+|\\s+$', '', 'g') ELSE 'Continue the following text:' END AS prompt, CASE WHEN a > 0 THEN regexp_replace(substr(t, a + 9), '^\\s+|\\s+$', '', 'g') ELSE t END AS response FROM e""")
def export_jsonl_sft(spark, sf_dir):
    """Prompt and response; every seventh document is given an answer mark, as the table has none."""
    marked = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n\nAnswer: yes "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", export.prompt_response(marked).alias("x")).select("doc_id", "x.prompt", "x.response")


@query("export_manifest", "WITH s AS (SELECT source, count(*) AS n, sum(length(text)) AS c, sum(length(text) // 4) AS t FROM documents GROUP BY source) SELECT CAST(sum(n) AS BIGINT) AS total_docs, CAST(sum(c) AS BIGINT) AS total_chars, CAST(sum(t) AS BIGINT) AS total_tokens, string_agg(source || '=' || n, ',' ORDER BY source) AS source_breakdown FROM s")
def export_manifest(spark, sf_dir):
    m = export.manifest(table(spark, sf_dir, "documents"))
    return m.withColumn("source_breakdown", F.array_join(F.transform(F.map_entries("source_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("export_filter", f"SELECT doc_id FROM ({signals_sql('SELECT doc_id, lang, source, text FROM documents')}) WHERE text <> '' AND source <> '' AND lang IN ('en', 'fr') AND overall_quality >= 0.8::DOUBLE")
def export_filter(spark, sf_dir):
    rated = filters.quality_signals(table(spark, sf_dir, "documents")).select("doc_id", "text", "source", "lang", "overall_quality").persist(StorageLevel.MEMORY_AND_DISK)
    return export.keep_for_export(rated, languages=("en", "fr"), min_quality=0.8, language="lang").select("doc_id")


@query("shard_assignment")
def shard_assignment(spark, sf_dir):
    """Rolling shard numbers by source: at most 1,000 records or 256 KiB a shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    return export.shard_ids(docs, "source", "doc_id", "bytes", 1000, 256 << 10)


@query("quota_admission", "SELECT doc_id, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100000 AS admitted FROM documents")
def quota_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("bytes"))
    quotas = docs.select("source").distinct().withColumn("max_bytes", F.lit(100_000))
    return export.quota_admission(docs, "source", "doc_id", "bytes", quotas).select("doc_id", "used_before", "admitted")


@query("quota_usage", "SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS used_bytes, count(*) AS records FROM documents GROUP BY ROLLUP (source)")
def quota_usage(spark, sf_dir):
    return metrics.usage(table(spark, sf_dir, "documents"))


@query("train_val_split", "WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS r, count(*) OVER () AS t FROM s) SELECT source, CASE WHEN t > 1 AND r <= greatest(1, floor(t * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r")
def train_val_split(spark, sf_dir):
    return export.train_val_split(table(spark, sf_dir, "documents"), "source")


@query("text_preview", "SELECT doc_id, CASE WHEN length(text) > 120 THEN replace(substr(text, 1, 120), chr(10), ' ') || '…' ELSE replace(substr(text, 1, 120), chr(10), ' ') END AS preview FROM documents")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


WORDS = "(SELECT word, count(*) AS freq FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word)"


@query("word_frequency", f"SELECT word, freq FROM {WORDS}")
def word_frequency(spark, sf_dir):
    return tokenizer.word_frequency(table(spark, sf_dir, "documents"), pieces=words)


@query("bpe_pair_counts", f"""WITH h AS (SELECT freq, hex(word) AS h FROM {WORDS}), p AS (SELECT freq, h, unnest(range(0, length(h) // 2 - 1)) AS i FROM h)
    SELECT CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER) AS "left", CAST('0x' || substr(h, i * 2 + 3, 2) AS INTEGER) AS "right", CAST(sum(freq) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def bpe_pair_counts(spark, sf_dir):
    return tokenizer.pair_counts(tokenizer.word_frequency(table(spark, sf_dir, "documents"), pieces=words))


@query("bpe_pre_split_frequency")
def bpe_pre_split_frequency(spark, sf_dir):
    return tokenizer.word_frequency(table(spark, sf_dir, "documents"))


@query("bpe_encode")
def bpe_encode(spark, sf_dir):
    """Ids by 300 merges learned from the table itself."""
    docs = table(spark, sf_dir, "documents")
    out = tokenizer.encode(docs, tokenizer.train(docs, merges=300))
    return out.select("doc_id", F.size("ids").alias("n_ids"), F.octet_length("text").alias("n_bytes"), F.xxhash64("ids").alias("ids_hash"))


@query("sft_from_messages", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS input, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS output FROM conversations GROUP BY conv_id")
def sft_from_messages(spark, sf_dir):
    return prep.message_pairs(table(spark, sf_dir, "conversations"))


@query("chat_prompt", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def chat_prompt(spark, sf_dir):
    return prep.chat_prompt(table(spark, sf_dir, "conversations"))


@query("qa_best_answer", """WITH q AS (SELECT conv_id, min(turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT c.conv_id, c.turn, length(c.text) AS score, c.turn = q.q + 1 AND c.conv_id % 2 = 0 AS accepted FROM conversations c JOIN q USING (conv_id) WHERE role = 'assistant')
    SELECT conv_id, q.q AS question_turn, a.turn AS answer_turn FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY accepted DESC, score DESC, turn) AS r FROM a) a USING (conv_id) WHERE r = 1""")
def qa_best_answer(spark, sf_dir):
    """First user turn of each conversation with its best assistant turn (accepted in even conversations, else longest, else first)."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("question_turn"))
    told = rows.filter("role = 'assistant'").join(asked, "conv_id").select("conv_id", "turn", F.length("text").alias("score"), ((F.col("turn") == F.col("question_turn") + 1) & (F.col("conv_id") % 2 == 0)).alias("accepted"))
    return prep.best_answers(asked, told, "conv_id", "accepted", "score", "turn").select("conv_id", "question_turn", F.col("answer.turn").alias("answer_turn"))


ASKED = "CASE conv_id % 3 WHEN 0 THEN 'what is the ' || text WHEN 1 THEN text || ' latest' ELSE text END"


@query("search_intent", f"""WITH q AS (SELECT conv_id, turn, {ASKED} AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, w <> 'static_knowledge' AS needed, w AS why FROM (SELECT conv_id, turn,
    CASE WHEN regexp_matches(q, {quoted(rules.LIVE)}, 'i') THEN 'live_signal' WHEN len(regexp_extract_all(q, '\\S+')) <= 8 AND ({" OR ".join(f"starts_with(lower(q), {quoted(p)})" for p in rules.FACTUAL)}) THEN 'short_factual' ELSE 'static_knowledge' END AS w FROM q)""")
def search_intent(spark, sf_dir):
    """Search intent of user turns, two thirds of which are given a marker."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", enrich.needs_search(F.expr(ASKED)).alias("x"))
    return rows.select("conv_id", "turn", "x.needed", "x.why")


@query("grounded_prompt", f"""WITH r AS (SELECT page_id % 50 AS grp, page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS title, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS body FROM pages),
    n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY page_id) AS i FROM r)
    SELECT grp, {quoted('Answer from the numbered sources below.' + chr(10) + prep.RULES + 'SOURCES:' + chr(10))} || trim(string_agg('[' || i || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || substr(body, 1, 1200), chr(10) || chr(10) ORDER BY i)) || chr(10) AS prompt FROM n GROUP BY grp""")
def grounded_prompt(spark, sf_dir):
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("grp"), "page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("title"), body.alias("body"))
    return prep.grounded_prompt(rows, "grp", "page_id", "title", "url", "body")


@query("citations", """WITH r AS (SELECT page_id % 50 AS grp, page_id, url, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS i FROM pages), a AS (SELECT DISTINCT page_id % 50 AS grp FROM pages)
    SELECT grp, CAST(i AS INTEGER) AS index, page_id, url FROM a JOIN r USING (grp) WHERE i IN (1, 1 + grp % 7)""")
def citations(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("grp"), "page_id", "url")
    answers = rows.select("grp").distinct().withColumn("answer", F.concat(F.lit("So says [1], and ["), (1 + F.col("grp") % 7).cast("string"), F.lit("] with [1] and [99999].")))
    return prep.citations(answers, rows, "grp", "answer", "page_id").select("grp", "index", "row.page_id", "row.url")


@query("metric_ema", "SELECT event_type, list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a) AS ema, count(*) AS n FROM events GROUP BY event_type")
def metric_ema(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return metrics.ema(rows, "event_type", "at", "value").withColumn("n", F.col("n").cast("long"))


@query("running_best", "WITH r AS (SELECT event_id, value, min(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT event_id, least(value, coalesce(b, value)) AS best_so_far, b IS NULL OR value < b AS is_best FROM r")
def running_best(spark, sf_dir):
    return metrics.running(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").select("event_id", "best_so_far", "is_best")


@query("latest_n", "SELECT user_id, event_id, CAST(r AS INTEGER) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def latest_n(spark, sf_dir):
    return metrics.latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "newest")


def _micros(rows: DataFrame) -> DataFrame:
    return rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("progress", "SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS done, row_number() OVER w * 100.0::DOUBLE / count(*) OVER (PARTITION BY event_type) AS percent, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step_us, epoch_us(ts) - first_value(epoch_us(ts)) OVER w AS elapsed_us FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def progress(spark, sf_dir):
    return metrics.progress(_micros(table(spark, sf_dir, "events")), "event_type", ["ts", "event_id"], F.col("us")).select("event_id", "done", "percent", "step_us", "elapsed_us")


@query("rate_limit_window", "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS over_limit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)")
def rate_limit_window(spark, sf_dir):
    return metrics.window_count(_micros(table(spark, sf_dir, "events")), "user_id", "us", 21600, 2).select("event_id", "in_window", "over_limit")


@query("rate_limit_admitted")
def rate_limit_admitted(spark, sf_dir):
    """Exact admission, two requests in six hours, refused ones not counted."""
    rows = _micros(table(spark, sf_dir, "events")).select("event_id", "user_id", "us")
    return metrics.admitted(rows, "user_id", "us", "event_id", 21600, 2).select("event_id", "admitted")


@query("latency_histogram", f"SELECT event_type, {', '.join(f'count(*) FILTER (value / 100 <= {e}::DOUBLE) AS le_{k}' for k, e in enumerate(metrics.EDGES))}, count(*) AS n FROM events GROUP BY event_type")
def latency_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), F.col("value") / 100, "event_type")


@query("request_counters", "SELECT event_type, user_id % 4 AS endpoint, count(*) AS requests FROM events GROUP BY ALL")
def request_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("endpoint")).agg(F.count(F.lit(1)).alias("requests"))


@query("lr_schedule", "SELECT event_id, CAST(round(1e9::DOUBLE * (512::DOUBLE ** -0.5::DOUBLE) * least(greatest(event_id, 1)::DOUBLE ** -0.5::DOUBLE, greatest(event_id, 1)::DOUBLE * (4000::DOUBLE ** -1.5::DOUBLE))) AS BIGINT) AS rate_nano FROM events")
def lr_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.lit(1e9) * metrics.warm_up_rate(F.col("event_id"))).cast("long").alias("rate_nano"))


@query("loss_summary", "SELECT event_type, count(value) AS n, min(value) AS best, CAST(round(sum(value::DECIMAL(20,6)) * 1000000) AS BIGINT) AS total_micro FROM events GROUP BY event_type")
def loss_summary(spark, sf_dir):
    out = metrics.loss_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", "best", (F.col("total") * 1_000_000).cast("long").alias("total_micro"))


@query("event_windows", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Hourly tumbling windows, the batch form of the streaming aggregate."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")
