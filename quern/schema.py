"""The document row and its nested structs."""

from pyspark.sql import types as T

SIGNALS = ("coherence_score", "readability_score", "factual_density", "educational_value", "reasoning_quality", "spam_probability", "toxicity_score", "hate_score", "explicit_score", "boilerplate_ratio", "markup_noise", "repetition_ratio", "avg_word_length", "avg_sentence_length", "alpha_ratio", "digit_ratio", "uppercase_ratio", "overall_quality")
QUALITY = T.StructType([T.StructField(name, T.DoubleType()) for name in SIGNALS])
DEDUP = T.StructType([
    T.StructField("exact_hash", T.StringType()), T.StructField("simhash", T.LongType()), T.StructField("minhash_sig", T.ArrayType(T.LongType())),
    T.StructField("is_duplicate", T.BooleanType()), T.StructField("duplicate_of", T.StringType()), T.StructField("near_dup_score", T.DoubleType()),
])
_TEXT = ("doc_id", "text", "title", "url", "source_name", "source_url", "dump_version", "domain", "language")
DOCUMENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in _TEXT], T.StructField("lang_confidence", T.DoubleType()),
    *[T.StructField(n, T.StringType()) for n in ("category", "license", "source_timestamp")], T.StructField("ingested_at", T.DoubleType()),
    *[T.StructField(n, T.LongType()) for n in ("char_count", "word_count", "token_estimate")], T.StructField("stage", T.StringType()),
    T.StructField("rejected", T.BooleanType()), T.StructField("rejection_reason", T.StringType()), T.StructField("quality", QUALITY), T.StructField("dedup", DEDUP),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("shard_id", T.StringType()), T.StructField("shard_offset", T.LongType()),
])
DEFAULTS = {"domain": "unknown", "language": "en", "lang_confidence": 0.0, "license": "unknown", "stage": "raw", "rejected": False}
