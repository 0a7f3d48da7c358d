"""Scalar functions on text: the document and query tokenizers, and plain decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate the tokens of a document.
SEPARATORS = ' "?.,:()<>“”;!~\'|#{}[]$‘’*-+%&—–_/'

#: Longest token that is indexed; longer ones keep their position and count in the length.
MAX_TOKEN = 30

_BREAKS = SEPARATORS[1:] + "\r\n"


def document_tokens(text: Column) -> Column:
    """Tokens of a document body in order; line ends separate too, runs collapse. A null text has none.

    Separators become spaces and the text is split once: linear in its
    length, where extracting each match copies the text per match.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), _BREAKS, " " * len(_BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def indexed(token: Column) -> Column:
    """Whether a token is short enough to be indexed (tested before lower-casing)."""
    return F.length(token) <= MAX_TOKEN


def query_words(text: Column) -> Column:
    """Words of a query: split on spaces only, punctuation kept, lower case, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def plain_decimal(x: Column | str) -> Column:
    """A double in plain notation: the digits of its text form, no exponent, no trailing zeros; null stays null."""
    text = (F.col(x) if isinstance(x, str) else x).cast("string")
    part = lambda i: F.regexp_extract(text, r"^(-?)([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", i)
    digits = F.concat(part(2), part(3))
    point = F.length(part(2)) + F.coalesce(part(4).try_cast("int"), F.lit(0))
    n = F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    value = F.col(x) if isinstance(x, str) else x
    return F.when(value == 0, F.lit("0")).when(F.isnan(value) | (F.abs(value) == float("inf")), text).otherwise(F.concat(part(1), short))
