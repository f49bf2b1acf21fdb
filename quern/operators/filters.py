"""Language, safety and quality gates: each adds its signals and the first rule that a row breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules
from quern.functions.text import adjacent, blank_if_null, capitals, count_of, digits, letters, sentence_count, strip, words


def script_language(text: Column) -> Column:
    """struct(language, confidence) from the scripts of the first 300 characters."""
    head = F.substring(blank_if_null(text), 1, 300)
    n = F.greatest(F.length(head), F.lit(1))
    share = lambda pattern: F.regexp_count(head, F.lit(pattern)) / n
    told = lambda name, sure: F.struct(F.lit(name).alias("language"), F.lit(sure).alias("confidence"))
    return (
        F.when(share(r"\p{IsLatin}") > 0.60, told("en", 0.70)).when(share(r"[一-鿿]") > 0.20, told("zh", 0.80))
        .when(share(r"[Ѐ-ӿ]") > 0.20, told("ru", 0.75)).when(share(r"[؀-ۿ]") > 0.20, told("ar", 0.75)).otherwise(told("en", 0.50))
    )


def language_gate(docs: DataFrame, text: str = "text", source: str = "source", targets=("en",), min_confidence: float = 0.80, pass_on_uncertainty: bool = False, overrides: dict | None = None, detector=script_language) -> DataFrame:
    """Add language, lang_confidence and language_rule.

    ``overrides`` maps a source to its own targets; ``*`` among them accepts without detection.
    """
    out = docs.withColumn("_found", detector(F.col(text))).withColumns({"language": F.col("_found.language"), "lang_confidence": F.col("_found.confidence")}).drop("_found")
    free, allowed = F.lit(False), F.col("language").isin(*targets)
    for name, own in (overrides or {}).items():
        here = F.col(source) == name
        if "*" in own:
            free = free | here
        else:
            allowed = F.when(here, F.col("language").isin(*own)).otherwise(allowed)
    unsure = F.col("lang_confidence") < min_confidence
    off = F.when(~allowed, F.lit("language_not_target"))
    rule = F.when(unsure, F.lit(None).cast("string") if pass_on_uncertainty else F.lit("lang_confidence_too_low")).otherwise(off)
    return out.withColumn("language_rule", F.when(free, F.lit(None).cast("string")).otherwise(rule))


def safety_gate(docs: DataFrame, text: str = "text", max_spam_density: float = 3.0, max_injection: int = 1) -> DataFrame:
    """Add spam_hits, injection_hits, n_words and safety_rule, the first pattern group that matches."""
    t, ci = F.col(text), "(?i)"
    out = docs.withColumns({"spam_hits": count_of(t, ci + rules.SPAM), "injection_hits": count_of(t, ci + rules.INJECTION), "n_words": F.size(words(t))})
    density = F.col("spam_hits") / (F.greatest(F.col("n_words"), F.lit(1)) / 100)
    rule = (
        F.when(t.rlike(ci + rules.HATE), "hate_speech_keyword").when(t.rlike(ci + rules.EXPLICIT), "explicit_content_keyword")
        .when(density > max_spam_density, "spam_density").when(F.col("injection_hits") > max_injection, "prompt_injection")
        .when(t.rlike(ci + rules.MALWARE), "malware_signature").when(t.rlike(ci + rules.PII), "exposed_pii").when(t.rlike(ci + rules.SYNTHETIC), "synthetic_content_marker")
    )
    return out.withColumn("safety_rule", rule)


def safety_signals(docs: DataFrame, text: str = "text", scorer=None, max_toxicity: float = 0.80, max_hate: float = 0.70, max_explicit: float = 0.85) -> DataFrame:
    """safety_gate, and on accepted rows toxicity_score, hate_score, explicit_score, spam_probability (null on others).

    ``scorer`` turns the first 512 characters of a text into struct(toxicity, hate, explicit),
    such as a Pandas UDF over a model; its limits come after the pattern rules, a null struct passes.
    Without one the three scores are 0 and the spam density gives spam_probability.
    """
    out = safety_gate(docs, text)
    density = F.col("spam_hits") / (F.greatest(F.col("n_words"), F.lit(1)) / 100)
    kinds = ("toxicity", "hate", "explicit")
    if scorer is None:
        scores = {k: F.lit(0.0) for k in kinds}
    else:
        head = F.when(F.col("safety_rule").isNull(), F.substring(blank_if_null(F.col(text)), 1, 512))
        out = out.withColumn("_scores", scorer(head))
        scores = {k: F.coalesce(F.col(f"_scores.{k}"), F.lit(0.0)) for k in kinds}
        over = F.when(scores["toxicity"] > max_toxicity, "model_toxicity").when(scores["hate"] > max_hate, "model_hate").when(scores["explicit"] > max_explicit, "model_explicit")
        out = out.withColumn("safety_rule", F.coalesce("safety_rule", over))
    kept = F.col("safety_rule").isNull()
    spam = F.lit(0.0) if scorer is not None else density / 10
    told = {f"{k}_score": F.when(kept, scores[k]) for k in kinds} | {"spam_probability": F.when(kept, spam)}
    return out.withColumns(told).drop("_scores")


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the integer counts that all quality signals derive from; one pass of built-in functions."""
    t = blank_if_null(F.col(text))
    w, paragraphs = F.col("_w"), F.filter(F.split(t, "\n\n"), lambda p: F.length(F.trim(p)) > 0)
    grams = adjacent(F.slice(w, 1, 500), 3, "\u0001")
    return docs.withColumn("_w", words(t)).withColumn("_g", grams).withColumns({
        "n_chars_all": F.length(t), "n_alpha": letters(t), "n_digit": digits(t), "n_upper": capitals(t), "n_words": F.size(w),
        "word_chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), "n_unique": F.size(F.array_distinct(F.transform(w, F.lower))),
        "n_sentences": sentence_count(t), "n_paragraphs": F.size(paragraphs), "n_long_paragraphs": F.size(F.filter(paragraphs, lambda p: F.size(words(p)) >= 10)),
        "n_grams": F.size("_g"), "n_repeated": F.size("_g") - F.size(F.array_distinct("_g")), "n_boilerplate": count_of(t, "(?i)" + rules.BOILERPLATE),
        "markup_chars": F.aggregate(F.regexp_extract_all(t, F.lit(rules.MARKUP), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x)), "n_urls": count_of(t, "(?i)https?://"),
        "n_educational": F.size(F.array_intersect(F.array_distinct(F.transform(w, F.lower)), F.array(*map(F.lit, rules.EDUCATIONAL)))), "n_punctuation": count_of(t, "[.,;:!?]"),
    }).drop("_w", "_g")


def quality_signals(docs: DataFrame, text: str = "text", min_alpha: float = 0.50, min_unique: float = 0.25, word_length=(3.0, 15.0), max_url_density: float = 5.0, weights=rules.WEIGHTS) -> DataFrame:
    """Add the ratios and overall_quality (unrounded; the composite is added up in a fixed order)."""
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    cap = lambda c: F.least(c, F.lit(1.0))
    out = quality_counts(docs, text).withColumns({
        "alpha_ratio": F.col("n_alpha") / one("n_chars_all"), "digit_ratio": F.col("n_digit") / one("n_chars_all"), "upper_ratio": F.col("n_upper") / one("n_alpha"),
        "mean_word_length": F.col("word_chars") / one("n_words"), "unique_ratio": F.col("n_unique") / one("n_words"), "mean_sentence_length": one("n_words") / F.col("n_sentences"),
        "paragraph_ratio": F.col("n_long_paragraphs") / one("n_paragraphs"), "repetition_ratio": F.col("n_repeated") / one("n_grams"), "boilerplate_ratio": cap(F.col("n_boilerplate") / F.col("n_sentences")),
        "markup_ratio": F.col("markup_chars") / one("n_chars_all"), "url_density": F.col("n_urls") / (one("n_words") / 100), "educational_density": cap(F.col("n_educational") / one("n_words") * 10),
        "punctuation_ok": cap(F.col("n_punctuation") / F.col("n_sentences")),
    })
    terms = [
        F.lit(weights["alpha"]) * cap(F.col("alpha_ratio") / F.lit(max(min_alpha, 0.01))), F.lit(weights["unique"]) * cap(F.col("unique_ratio") / F.lit(max(min_unique, 0.01))),
        F.lit(weights["educational"]) * F.col("educational_density"), F.lit(weights["paragraph"]) * F.col("paragraph_ratio"),
        F.lit(weights["word_length"]) * F.when(F.col("mean_word_length").between(*word_length), 1.0).otherwise(0.3), F.lit(weights["punctuation"]) * F.col("punctuation_ok"),
        F.lit(weights["repetition"]) * F.col("repetition_ratio"), F.lit(weights["markup"]) * F.col("markup_ratio"), F.lit(weights["boilerplate"]) * F.col("boilerplate_ratio"),
        F.lit(weights["uppercase"]) * F.col("upper_ratio"), F.lit(weights["url"]) * cap(F.col("url_density") / F.lit(max(max_url_density, 1.0))),
    ]
    total = reduce(lambda a, b: a + b, terms, F.lit(0.0))
    return out.withColumn("overall_quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total + F.lit(0.5))))


def short_line_ratio(text: Column, short: int = 20) -> Column:
    """Lines of 1 to ``short`` - 1 characters among the lines that are not blank."""
    sizes = F.filter(F.transform(F.split(blank_if_null(text), "\n"), lambda x: F.length(strip(x))), lambda n: n > 0)
    return F.size(F.filter(sizes, lambda n: n < short)) / F.greatest(F.size(sizes), F.lit(1))


def derived_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """quality_signals, the signals that follow from them, and the short-line ratio."""
    cap = lambda c: F.least(c, F.lit(1.0))
    return quality_signals(docs, text).withColumns({
        "coherence_score": F.col("paragraph_ratio"), "readability_score": cap(F.col("mean_sentence_length") / 20),
        "reasoning_quality": cap(F.col("educational_density") * F.col("paragraph_ratio") * F.lit(1.5)), "spam_probability": cap(F.col("boilerplate_ratio") + F.col("url_density") / 10),
        "short_line_ratio": short_line_ratio(F.col(text)),
    })


def quality_gate(docs: DataFrame, text: str = "text", min_words: int = 20, min_alpha: float = 0.50, max_digit: float = 0.30, max_upper: float = 0.20, max_repetition: float = 0.25, max_boilerplate: float = 0.15, max_markup: float = 0.05, min_quality: float = 0.35) -> DataFrame:
    """quality_signals and quality_rule; the character ratios are compared after rounding to 4 places."""
    rounded = lambda c: F.round(F.col(c), 4)
    rule = (
        F.when(F.col("n_words") < min_words, "too_few_words").when(rounded("alpha_ratio") < min_alpha, "low_alpha").when(rounded("digit_ratio") > max_digit, "high_digit")
        .when(rounded("upper_ratio") > max_upper, "high_uppercase").when(F.col("repetition_ratio") > max_repetition, "high_repetition").when(F.col("boilerplate_ratio") > max_boilerplate, "high_boilerplate")
        .when(F.col("markup_ratio") > max_markup, "high_markup").when(rounded("overall_quality") < min_quality, "low_quality")
    )
    return quality_signals(docs, text, min_alpha=min_alpha).withColumn("quality_rule", rule)
