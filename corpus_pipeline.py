"""The corpus pipeline: five stages, each one of the training-data operators.

``run`` applies them to ``documents``; each stage is written as Parquet in the shared folder and
read again as the next one's input.  All but the last return the columns of ``documents``.
Whole texts go to Python in small batches, a setting that stays with the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, mixing, simhash, tokenstore, toxicity
from quern.llm.common import shared_dir, small_batches, stored
from quern.llm.queries import END_ID, TARGETS, TOKENIZER, labelled_domains, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity is below 0.3."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of five-word similarity 0.8 or more."""
    small_batches(spark)
    return simhash.keep_one(docs, width=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered by 0.8 or more."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates, which are 1 or more: scarce domains are seen again."""
    small_batches(spark)
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files written."""
    small_batches(spark)
    import public_tokenizers

    path = shared_dir(spark, "tokens")
    tokenstore.write_tokens(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    return tokenstore.token_report(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_domains),
    ("tokens", write_tokens),
]

#: The learned stages have no SQL; the tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
