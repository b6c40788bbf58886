"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import config


def normalized_breaks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+$", "")


def canonical(text: Column) -> Column:
    """Line ends as \\n, no blanks before them, at most one empty line between lines, no white space around."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(plain, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def lexical(text: Column) -> Column:
    """Lower case, one form of e with diaeresis in Cyrillic, letters, digits, hyphens and single blanks only."""
    plain = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}\s-]+", " "), r"(?U)\s+", " "))


def terms(text: Column, least: int = 2) -> Column:
    """The words of lexical(text): runs of letters, digits and hyphens, found in one pass over the text."""
    plain = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.regexp_extract_all(plain, F.lit(rf"[a-z0-9\p{{L}}\p{{N}}-]{{{least},}}"), F.lit(0))


def ngrams(text: Column, n: int = config.NGRAM) -> Column:
    """The set of character n-grams; a text of at most n characters is its own. A lookahead finds them in one pass, where each
    substring would count its place from the text's start; it counts UTF-16 units, so other texts than of the basic plane
    are cut one by one."""
    one_by_one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    in_one = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    many = F.array_distinct(F.when(F.regexp_like(text, F.lit(r"[\x{10000}-\x{10FFFF}]")), one_by_one).otherwise(in_one))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(many)


def dice(a: Column, b: Column) -> Column:
    """Overlap of two sets: twice the common part over the sizes' sum; 0 if both are empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def clamped(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits
