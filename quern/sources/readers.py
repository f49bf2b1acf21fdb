"""Source readers: every one returns rows of the same few document columns, declared as Spark scans.

Malformed records are dropped by the readers' own modes; limits and offsets are ordinary
DataFrame operations, so that filters and pruning reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import rules
from quern.functions.text import strip, word_count
from quern.operators.enrich import book_text, host, html_text, post_body, wikitext
from quern.operators.export import natural_key, shard_ids
from quern.schema import DEFAULTS, DOCUMENT


def documents(rows: DataFrame, source_name: str, metadata: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """Rows in the document schema: given columns, constants, derived sizes, the rest null."""
    told = {"source_name": F.lit(source_name), **{k: F.lit(v) for k, v in DEFAULTS.items()}, **columns}
    told["doc_id"] = told.get("doc_id", F.sha2(F.concat_ws("\u0001", F.lit(source_name), told.get("url", F.lit("")), told["text"]), 256))
    told |= {"char_count": F.length(told["text"]).cast("long"), "word_count": word_count(told["text"]).cast("long"), "token_estimate": F.floor(F.length(told["text"]) / 4)}
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    told["metadata"] = F.create_map(*pairs) if pairs else F.lit(None)
    return rows.select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


def text_lines(spark: SparkSession, path: str, least: int = 500, source: str = "encyclopaedia", **columns: Column) -> DataFrame:
    """Each stripped line of at least ``least`` characters of the text files is a document."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("value"), F.col("_metadata.file_name").alias("file")).filter(F.length("value") >= least)
    return documents(rows, source, {"source_file": F.col("file")}, text=F.col("value"), **columns)


PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("ns", T.StringType()), T.StructField("id", T.LongType()), T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("text", T.StringType())])),
])


def wiki_pages(spark: SparkSession, path: str, least: int = 500, most: int = 100_000, language: str = "en", site: str = "https://{}.wikipedia.org/wiki/") -> DataFrame:
    """Articles of a page dump (compression by file extension): namespace 0, no redirects, lists or disambiguations."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    low = F.lower("title")
    skip = low.contains("disambiguation") | low.contains("list of")
    for prefix in rules.SKIPPED_TITLES:
        skip = skip | F.col("title").startswith(prefix)
    rows = rows.filter((F.col("ns") == "0") & F.col("redirect").isNull() & ~skip & F.col("revision.text").isNotNull())
    rows = rows.withColumn("text", wikitext(F.col("revision.text"))).filter(F.length("text") >= least).withColumn("text", F.substring("text", 1, most))
    return documents(
        rows, "wikipedia", {"page_id": F.col("id"), "revision_id": F.col("revision.id")}, text=F.col("text"), title=F.col("title"), language=F.lit(language), domain=F.lit("encyclopedia"),
        url=F.concat(F.lit(site.format(language)), F.replace("title", F.lit(" "), F.lit("_"))), source_timestamp=F.col("revision.timestamp"),
    )


def posts(spark: SparkSession, path: str, site: str = "stack", min_question: int = 1, min_answer: int = 2, least: int = 100) -> DataFrame:
    """Questions with their best answer (accepted, else highest score, else first)."""
    fields = ("Id", "PostTypeId", "ParentId", "AcceptedAnswerId", "Score", "Title", "Body", "Tags", "CreationDate")
    kind = lambda f: T.StringType() if f in ("Title", "Body", "Tags", "CreationDate") else T.LongType()
    rows = spark.read.format("xml").option("rowTag", "row").schema(T.StructType([T.StructField(f"_{f}", kind(f)) for f in fields])).load(path)
    q = rows.filter((F.col("_PostTypeId") == 1) & (F.col("_Score") >= min_question)).select(F.col("_Id").alias("q"), F.col("_AcceptedAnswerId").alias("want"), F.col("_Title").alias("title"), F.col("_Body").alias("q_body"), F.col("_Score").alias("q_score"), F.col("_Tags").alias("tags"), F.col("_CreationDate").alias("at"))
    a = rows.filter((F.col("_PostTypeId") == 2) & (F.col("_Score") >= min_answer)).select(F.col("_ParentId").alias("q"), F.col("_Id").alias("a"), F.col("_Score").alias("a_score"), F.col("_Body").alias("a_body"))
    met = q.join(a, "q").withColumn("accepted", F.coalesce(F.col("a") == F.col("want"), F.lit(False)))
    best = met.groupBy("q").agg(F.max(F.struct(F.col("accepted").cast("int").alias("x"), F.col("a_score"), (-F.col("a")).alias("o"), F.struct(*met.columns).alias("row"))).alias("b")).select("b.row.*")
    tags = F.replace(F.btrim("tags", F.lit("<>")), F.lit("><"), F.lit(","))
    text = F.concat(F.lit("Q: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), post_body(F.col("q_body")), F.lit("\n\nAnswer: "), post_body(F.col("a_body")))
    best = best.withColumn("text", text).filter(F.length("text") >= least)
    return documents(best, site, {"q_id": F.col("q"), "a_id": F.col("a"), "q_score": F.col("q_score"), "a_score": F.col("a_score"), "accepted": F.col("accepted"), "tags": tags}, text=F.col("text"), title=F.col("title"), category=F.split_part(tags, F.lit(","), F.lit(1)), domain=F.lit("qa"), source_timestamp=F.col("at"))


def preprints(spark: SparkSession, path: str, categories=("cs", "math", "physics", "stat"), least: int = 200) -> DataFrame:
    """Title and abstract of the records in the wanted categories."""
    fields = ("id", "title", "abstract", "categories", "authors", "journal-ref", "doi", "update_date")
    rows = spark.read.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).option("mode", "DROPMALFORMED").json(path)
    rows = rows.withColumn("prefixes", F.transform(F.filter(F.split(F.coalesce("categories", F.lit("")), r"\s+"), lambda c: c != ""), lambda c: F.split_part(c, F.lit("."), F.lit(1)))).withColumn("abstract", strip(F.col("abstract"))).withColumn("title", strip(F.col("title")))
    rows = rows.filter((F.length("abstract") >= least) & F.arrays_overlap("prefixes", F.array(*map(F.lit, categories))))
    first = F.element_at("prefixes", 1)
    domain = F.lit("science")
    for prefix, name in rules.PREPRINT_DOMAINS.items():
        domain = F.when(first == prefix, name).otherwise(domain)
    return documents(rows, "arxiv", {"arxiv_id": F.col("id"), "categories": F.col("categories"), "authors": F.col("authors"), "journal_ref": F.col("journal-ref"), "doi": F.col("doi")}, text=F.concat_ws("\n\n", "title", "abstract"), title=F.col("title"), category=first, domain=domain, source_timestamp=F.col("update_date"))


def books(spark: SparkSession, catalog: str, folder: str, languages=("en",), subjects=(), least: int = 5000, most_books: int = 0) -> DataFrame:
    """Texts of the catalogue's books: ``<id>-0.txt`` before ``<id>.txt``, boilerplate stripped."""
    told = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(catalog)
    wanted = (F.col("Type") == "Text") & F.col("Language").isin(*languages)
    if subjects:
        named = F.lit(False)
        for s in subjects:
            named = named | F.lower("Subjects").contains(s.lower())
        wanted = wanted & named
    told = told.filter(wanted)
    if most_books:
        told = told.orderBy(F.col("`Text#`").cast("int")).limit(most_books)
    files = spark.read.text(folder, wholetext=True).select(F.col("value"), F.regexp_extract("_metadata.file_name", r"^(\d+)(?:-0)?\.txt$", 1).alias("n"), F.col("_metadata.file_name").endswith("-0.txt").alias("first"))
    best = files.filter("n <> ''").groupBy("n").agg(F.max_by("value", F.col("first").cast("int")).alias("value"))
    rows = told.join(best, F.col("`Text#`") == F.col("n")).withColumn("text", book_text(F.col("value"))).filter(F.length("text") >= least)
    return documents(rows, "gutenberg", {"gutenberg_id": F.col("`Text#`"), "author": F.col("Authors"), "subjects": F.col("Subjects"), "issued": F.col("Issued")}, text=F.col("text"), title=F.col("Title"), language=F.col("Language"), domain=F.lit("literature"), license=F.lit("public_domain"))


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """(type, url, date, body) of every WARC record, gzip members inflated; the last record included."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import re

        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                at = 0
                while (m := re.compile(rb"WARC/1\.[01]\r\n").search(data, at)) is not None:
                    end = data.find(b"\r\n\r\n", m.end())
                    if end < 0:
                        break
                    head = {}
                    for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n"):
                        k, _, v = line.partition(":")
                        head[k.strip().lower()] = v.strip()
                    n = int(head.get("content-length") or 0)
                    body = data[end + 4 : end + 4 + n]
                    at = end + 4 + n
                    if body[:2] == b"\x1f\x8b":
                        body = gzip.decompress(body)
                    if body[:5] == b"HTTP/":
                        body = body.partition(b"\r\n\r\n")[2]
                    rows.append((head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), body.decode("utf-8", "replace")))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.record_batch([pa.array(list(c), pa.string()) for c in columns], names=["type", "url", "date", "body"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "type string, url string, date string, body string")


def crawl(spark: SparkSession, path: str, blocked: DataFrame | None = None, least: int = 200) -> DataFrame:
    """Responses whose host is not blocked, as text."""
    rows = warc_records(spark, path).filter("type = 'response'").withColumn("host", host(F.col("url")))
    if blocked is not None:
        rows = rows.join(blocked, "host", "left_anti")
    rows = rows.withColumn("text", html_text(F.col("body"))).filter(F.length("text") >= least)
    return documents(rows, "commoncrawl", {"warc_type": F.col("type"), "warc_date": F.col("date")}, text=F.col("text"), url=F.col("url"), domain=F.lit("web"), source_timestamp=F.col("date"))


def code_files(spark: SparkSession, path: str, extensions=rules.CODE_EXTENSIONS, least: int = 100, most: int = 50_000) -> DataFrame:
    """Code records with an allowed extension: ``# path``, a blank line and the code."""
    fields = ("path", "filename", "content", "code", "url", "repo_name")
    rows = spark.read.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).option("mode", "DROPMALFORMED").json(path)
    rows = rows.select(F.coalesce("path", "filename", F.lit("")).alias("name"), F.coalesce("content", "code", F.lit("")).alias("body"), "url", "repo_name").withColumn("ext", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    rows = rows.filter(F.col("ext").isin(*extensions) & (F.length("body") >= least)).withColumn("body", F.substring("body", 1, most))
    return documents(rows, "github", {"filename": F.col("name"), "repo": F.col("repo_name"), "language": F.substring("ext", 2, 20)}, text=F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), F.col("body")), title=F.col("name"), url=F.col("url"), domain=F.lit("code"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank and invalid lines and a byte-order mark are left out."""
    rows = spark.read.text(path).select(F.regexp_replace(F.trim("value"), "^\\uFEFF", "").alias("value")).filter("value <> ''")
    return rows.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).filter("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Document rows of written shards, rejected ones left out."""
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(paths).filter(~F.col("_metadata.file_path").contains("rejected"))


def sampled_lines(spark: SparkSession, path: str, quota: int) -> DataFrame:
    """At most ``quota`` non-empty lines of each file, those with the least hash: a sample by design."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.length(F.trim("value")) > 0)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.xxhash64("value"), "value"))).filter(F.col("_n") <= quota).select("value", "file")


def lines_after(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(file, line_no, value) of the non-empty lines after the first ``skip`` of each file, untrimmed; a file is one row until it is split."""
    return skip_lines(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), skip)


def skip_lines(files: DataFrame, skip: int = 0, breaks: str = r"\r\n|\r|\n") -> DataFrame:
    """(file, line_no, value) as of ``lines_after`` for whole files in rows of (file, value), as a container of many small files holds them."""
    lines = files.select("file", F.posexplode(F.split("value", breaks)).alias("line_no", "value"))
    return lines.filter((F.col("line_no") >= skip) & (F.col("value") != ""))


def tail(lines: DataFrame, most: int, file: str = "file", order: str = "line_no", value: str = "value") -> DataFrame:
    """The last ``most`` non-blank lines, the last file in natural order first; a top-k, not a sort of all."""
    rows = lines.withColumn(value, strip(F.col(value))).filter(F.col(value) != "")
    return rows.orderBy(F.desc(natural_key(F.col(file))), F.desc(order)).limit(most)


def chunks(lines: DataFrame, size: int, file: str = "file", order: str = "line_no", value: str = "value") -> DataFrame:
    """Add chunk: a chunk of a file's lines, blank ones too, ends once it holds ``size`` characters."""
    sized = lines.withColumn("_n", F.length(value).cast("long"))
    return shard_ids(sized, file, order, "_n", 1 << 62, size, after=True).drop("_n").withColumnRenamed("shard", "chunk")


def dump_link(page: Column, base: str) -> Column:
    """The first link to a multistream article dump in an index page, else to a plain one, else null."""
    found = lambda name: F.regexp_extract(page, f'href="([^"]*{name}[.]xml[.]bz2)"', 1)
    best, plain = found("pages-articles-multistream"), found("pages-articles")
    return F.when(best != "", F.concat(F.lit(base), best)).when(plain != "", F.concat(F.lit(base), plain))


def archive_paths(spark: SparkSession, path: str, base: str, most: int, fallback: tuple[str, ...] = ()) -> list[str]:
    """The first ``most`` archive addresses of a (compressed) list, or those given if it cannot be read."""
    try:
        return [base + r["value"] for r in spark.read.text(path).filter("trim(value) <> ''").limit(most).collect()]
    except AnalysisException:
        return list(fallback[:most])


def prune(sources: DataFrame, name: str = "source", only=(), skip=(), completed: DataFrame | None = None) -> DataFrame:
    """The sources to run: wanted, not skipped, not completed."""
    out = sources.filter(F.col(name).isin(*only)) if only else sources
    out = out.filter(~F.col(name).isin(*skip)) if skip else out
    return out.join(completed, name, "left_anti") if completed is not None else out


#: Readers by kind of source.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"text": text_lines, "wikipedia": wiki_pages, "stackexchange": posts, "arxiv": preprints, "gutenberg": books, "commoncrawl": crawl, "github": code_files}
