"""The registered training-data queries: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, exactdedup, katz, linededup, mixing, simhash, tokenstore, toxicity, urlfilter, warc
from quern.llm.common import shared_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: The production mixture: weights of the domains in expected tokens.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, domain) of the documents in the labelled table; the domain is the language."""
    told = labels.select(F.col("doc_id").alias("k")).distinct()
    return docs.join(told, docs["doc_id"] == told["k"], "left_semi").select("text", F.col("lang").alias("domain"))


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of whole documents, learned from document labels outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the numbers of the lines that fuzzy line de-duplication drops."""
    docs = table(spark, sf_dir, "documents")
    return linededup.line_report(linededup.line_groups(docs), docs)


def op3_decontamination_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that string tiling covers by 0.8 or more."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to monolithic WARC archives, normalised to one member a record, read back by index."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff log-probabilities of whole documents, trained outside fold 2 of 7."""
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact de-duplication of documents as a stateful stream; of equal texts the largest id stays."""
    return exactdedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on page URLs: host and path rules, then the character-model ratio."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents written as Parquet lists in key order, and what the files hold."""
    import public_tokenizers

    path = shared_dir(spark, "tokens")
    tokenstore.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return tokenstore.token_report(spark, path)


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors over the language domains and fitted rates of every document."""
    docs = table(spark, sf_dir, "documents")
    rated, _ = mixing.mixture(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)
    return rated.withColumn("copies", mixing.copies_of(F.col("rate"), F.col("doc_id")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of documents by covering hashing: 4-word shingles, radius 4."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_toxicity_mil": op1_toxicity_mil,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_decontamination_tiling": op3_decontamination_tiling,
    "op4_warc_normaliser": op4_warc_normaliser,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_token_parquet": op8_token_parquet,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE = {
    "op4_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             x AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS d, min(page_id) OVER (PARTITION BY html) AS f FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
        FROM x""",
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id,
                     count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256 FROM d)""",
}
