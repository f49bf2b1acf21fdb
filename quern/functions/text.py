"""Column helpers over text: words, sentences, character classes, hashes.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Pieces between runs of white space."""
    return F.filter(F.split(blank_if_null(text), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(blank_if_null(text), F.lit(r"(?U)\S+"))


def sentence_count(text: Column) -> Column:
    """Pieces when cutting after ``.``, ``!`` or ``?`` before white space."""
    return F.regexp_count(blank_if_null(text), F.lit(r"(?U)[.!?]\s+")) + 1


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(blank_if_null(text), F.lit(pattern))


def letters(text: Column) -> Column:
    return count_of(text, r"\p{L}")


def digits(text: Column) -> Column:
    return count_of(text, r"\p{Nd}")


def capitals(text: Column) -> Column:
    return count_of(text, r"\p{Lu}")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def casefold(text: Column) -> Column:
    """Lower case with the one folding that matters for Latin text, sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def exact_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed and stripped."""
    return F.sha2(F.regexp_replace(strip(F.lower(blank_if_null(text))), SPACE, " "), 256)


def preview(text: Column, n: int = 120) -> Column:
    short = F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > n, F.concat(short, F.lit("…"))).otherwise(short)


def adjacent(items: Column, n: int, glue: str = "") -> Column:
    """The runs of ``n`` items, joined by ``glue``; empty for fewer items.

    Slices are zipped, so that no lambda evaluates the array again for each place.
    """
    size = F.greatest(F.size(items) - F.lit(n - 1), F.lit(0))
    out = F.slice(items, 1, size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, k + 1, size), lambda a, b: F.concat(a, F.lit(glue), b))
    return out
