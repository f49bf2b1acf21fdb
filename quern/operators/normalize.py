"""The twelve-step text normaliser."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import rules
from quern.functions.text import strip, word_count


@dataclass(frozen=True)
class NormalizeConfig:
    min_chars: int = 50
    max_chars: int = 0
    urls: bool = False
    emails: bool = True
    quotes: bool = True
    entities: bool = True
    spaces: bool = True


#: Characters that alone can make a text differ from its composed form.
UNSETTLED = r"[\p{M}̀-·क़-य़ড়-য়ਲ਼-ਫ਼ଡ଼ଢ଼གྷ-ྐྵᄀ-ᇿά-´  ΩKÅ〈〉⫝̸豈-﫿יִ-פֿ]"


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    import html

    return text.map(lambda t: None if t is None else html.unescape(t))


def _where(needed: Column, function, text: Column) -> Column:
    """Apply a Python function to the rows that need it; the others send null to Python."""
    return F.coalesce(function(F.when(needed, text)), text)


def cleaned(text: Column, config: NormalizeConfig = NormalizeConfig()) -> Column:
    """Steps one to eleven without the length test."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\uFEFF+", "")
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    if config.entities:
        out = _where(out.contains("&"), _unescape, out)
    out = _where(out.rlike(UNSETTLED), _compose, out)
    out = F.translate(out, rules.ZERO_WIDTH, "")
    out = F.regexp_replace(out, rules.CONTROL, "")
    if config.quotes:
        out = F.translate(out, rules.QUOTES_FROM, rules.QUOTES_TO)
        for old, new in (rules.LONG_DASH, rules.ELLIPSIS):
            out = F.replace(out, F.lit(old), F.lit(new))
    if config.urls:
        out = F.regexp_replace(out, rules.URL, " __URL__ ")
    if config.emails:
        out = F.regexp_replace(out, rules.EMAIL, " __EMAIL__ ")
    if config.spaces:
        out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    out = strip(out)
    return F.substring(out, 1, config.max_chars) if config.max_chars else out


def normalize(docs: DataFrame, text: str = "text", config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Replace ``text`` and add char_count, word_count, token_estimate and normalize_rule.

    A text that is too short keeps its original form and gets the rule
    ``too_short_after_normalisation``.
    """
    done = docs.withColumn("_clean", cleaned(F.col(text), config))
    short = F.length("_clean") < config.min_chars
    done = done.withColumn(text, F.when(short, F.col(text)).otherwise(F.col("_clean"))).withColumn("normalize_rule", F.when(short, F.lit("too_short_after_normalisation"))).drop("_clean")
    return done.withColumns({"char_count": F.length(text).cast("long"), "word_count": word_count(F.col(text)).cast("long"), "token_estimate": F.floor(F.length(text) / 4)})
