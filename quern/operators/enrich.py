"""Metadata enrichment, line cleaning, extraction projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import rules
from quern.functions.text import blank_if_null, casefold, count_of, strip, words


def topics(text: Column, most: int = 3) -> Column:
    """Names of the topics whose key words occur as substrings, best first."""
    low = F.lower(blank_if_null(text))
    scored = []
    for rank, (name, keys) in enumerate(rules.TOPICS.items()):
        hits = sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0))
        scored.append(F.struct((-hits).alias("s"), F.lit(rank).alias("r"), F.lit(name).alias("t")))
    found = F.array_sort(F.filter(F.array(*scored), lambda x: x["s"] < 0))
    return F.transform(F.slice(found, 1, most), lambda x: x["t"])


def enrich(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add token_estimate, topics, counts, syllables and the Flesch-Kincaid grade (unrounded)."""
    t = blank_if_null(F.col(text))
    out = docs.withColumn("_w", words(t)).withColumns({
        "token_estimate": F.greatest(F.lit(1), F.expr(f"length(coalesce({text}, '')) div 4").cast("int")), "topics": topics(t),
        "n_words": F.size("_w"), "sentence_count": F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.length(F.trim(s)) > 0)),
        "syllables": F.aggregate("_w", F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouAEIOU]+")))),
        "paragraph_count": F.size(F.filter(F.split(t, "\n\n"), lambda p: F.length(F.trim(p)) > 0)), "code_block_count": count_of(t, "```"), "has_lists": t.rlike(r"(?m)^\s*[-*•]\s"),
    }).drop("_w")
    n, s = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("sentence_count"), F.lit(1))
    grade = F.lit(0.39) * (n / s) + F.lit(11.8) * (F.col("syllables") / n) - F.lit(15.59)
    return out.withColumn("reading_grade", F.greatest(F.lit(0.0), F.least(F.lit(20.0), grade)))


def validate(docs: DataFrame, text: str = "text", source: str = "source", language: str = "lang", strict: bool = True) -> DataFrame:
    """Add validation_rule; with ``strict`` off an unknown language becomes ``xx`` instead."""
    known = F.coalesce(F.col(language).isin(*rules.LANGUAGES), F.lit(False))
    rule = F.when(F.coalesce(F.col(text), F.lit("")) == "", "empty_text").when(F.coalesce(F.col(source), F.lit("")) == "", "missing_source")
    if strict:
        return docs.withColumn("validation_rule", rule.when(~known, "invalid_language"))
    return docs.withColumn("validation_rule", rule).withColumn(language, F.when(known, F.col(language)).otherwise("xx"))


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) from 0."""
    return docs.select(key, F.posexplode(F.split(blank_if_null(F.col(text)), "\n")).alias("line_no", "line"))


def clean_line(line: Column) -> Column:
    out = line
    for pattern, new in rules.LINE_MARKUP:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def structural(line: Column) -> Column:
    found = F.lit(False)
    for pattern in rules.STRUCTURAL:
        found = found | line.rlike(pattern)
    return found


def line_quality(line: Column, least: int = 20, most: int = 2000) -> Column:
    n = F.greatest(F.length(line), F.lit(1))
    alpha = count_of(line, r"\p{L}")
    return (
        F.length(line).between(least, most) & (alpha / n >= 0.50) & (count_of(line, r"(?U)[^\p{L}\p{N}\s]") / n <= 0.25) & (count_of(line, r"\p{Nd}") / n <= 0.30)
        & ~line.rlike(r"(.)\1{4,}") & ~((line == F.upper(line)) & (alpha > 5))
    )


def clean_lines(lines: DataFrame, scope: str = "doc_id", order: str = "line_no", dedup: bool = True, least: int = 20, most: int = 2000) -> DataFrame:
    """Kept lines, cleaned, in their order; of equal folded lines in a scope the first stays."""
    # an exploded array of one holds each value, so that no filter or column works it out again
    held = lambda rows, value: rows.select(*[c for c in rows.columns if c != "line"], F.explode(F.array(value)).alias("line"))
    bare = held(lines, strip(F.col("line"))).filter((F.length("line") > 0) & ~structural(F.col("line")))
    out = held(bare, clean_line(F.col("line"))).filter(line_quality(F.col("line"), least, most))
    if not dedup:
        return out
    first = Window.partitionBy(scope, casefold(F.col("line"))).orderBy(order)
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def html_text(html: Column) -> Column:
    """Visible text: script, style and page furniture out, tags to blanks, white space collapsed."""
    out = F.regexp_replace(blank_if_null(html), r"(?is)<(script|style|nav|footer|header|aside)\b.*?</\1>", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))


def fetched_text(html: Column, most: int = 3000) -> Column:
    """The first ``most`` characters of a fetched page without scripts, styles and tags."""
    out = F.regexp_replace(blank_if_null(html), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    return F.substring(strip(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"(?U)\s+", " ")), 1, most)


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "https?://([^/]+)", 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def wikitext(text: Column, least: int = 0, most: int = 0) -> Column:
    out = text
    for pattern, new in rules.WIKITEXT:
        out = F.regexp_replace(out, pattern, new)
    out = strip(out)
    return F.substring(out, 1, most) if most else out


@F.pandas_udf(T.StringType())
def _unescape(text):
    import html

    return text.map(lambda t: None if t is None else html.unescape(t))


def post_body(body: Column) -> Column:
    """Text of a question-site post: entities decoded, code fenced, tags to blanks."""
    out = F.coalesce(_unescape(F.when(body.contains("&"), body)), body)
    for tag in ("code", "pre"):
        out = F.regexp_replace(out, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", "\n```\n$1\n```\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r" {2,}", " "))


def book_text(text: Column) -> Column:
    """A book without the boilerplate before the first start marker's line and after the end marker."""
    begin = F.lit(1)
    for marker in reversed(rules.BOOK_START):
        at = F.instr(text, marker)
        rest = F.instr(F.substr(text, F.greatest(at, F.lit(1))), "\n")
        begin = F.when(at > 0, F.when(rest > 0, at + rest).otherwise(at + len(marker))).otherwise(begin)
    stop = F.length(text) + 1
    for marker in reversed(rules.BOOK_END):
        at = F.instr(text, marker)
        stop = F.when(at > 0, at).otherwise(stop)
    return strip(F.substr(text, begin, F.greatest(stop - begin, F.lit(0))))


def log_fields(line: Column) -> Column:
    """struct(ts, level, name, msg); a line of another form is an INFO message as it stands."""
    bare = strip(line)
    part = lambda k: strip(F.regexp_extract(bare, rules.LOG_LINE, k))
    fits = bare.rlike(rules.LOG_LINE)
    return F.struct(F.when(fits, part(1)).alias("ts"), F.when(fits, part(2)).otherwise("INFO").alias("level"), F.when(fits, part(3)).otherwise("raw").alias("name"), F.when(fits, part(4)).otherwise(bare).alias("msg"))


def needs_search(query: Column) -> Column:
    """struct(needed, why) of a question."""
    low, n = F.lower(query), F.size(words(query))
    starts = F.lit(False)
    for prefix in rules.FACTUAL:
        starts = starts | low.startswith(prefix)
    live = query.rlike("(?i)" + rules.LIVE)
    why = F.when(live, "live_signal").when((n <= 8) & starts, "short_factual").otherwise("static_knowledge")
    return F.struct((why != "static_knowledge").alias("needed"), why.alias("why"))
