"""The part of a document that shows the query's words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.storage import materialize

_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}\-&#~])")


def pattern(words: list[str]) -> str:
    """Any of the words, in query order, as parts of the text; signs stand for themselves."""
    return "|".join("(" + _SPECIAL.sub(r"\\\1", w.lower()) + ")" for w in words)


def snippet(body: Column, words: list[str]) -> Column:
    """Lines from the one with the first word to the one with the last.

    The lower-cased body is scanned from the left until each query word was
    found (a word given twice never ends the scan); of every word the latest
    place counts.  The lines from the first to the last such place are the
    snippet, in the body's own case.  Null where no word is found.
    """
    if not words:
        return F.lit(None).cast("string")
    low, p = F.lower(body), pattern(words)
    found = F.regexp_extract_all(low, F.lit(p), F.lit(0))
    between = F.split(low, p, -1)
    distinct = F.array_distinct(found)
    firsts = F.transform(distinct, lambda w: F.array_position(found, w))
    stop = F.when(F.size(distinct) == len(words), F.array_max(firsts)).otherwise(F.size(found)).cast("int")
    seen = F.slice(found, 1, F.greatest(stop, F.lit(1)))
    backwards = F.reverse(seen)
    lasts = F.transform(distinct, lambda w: stop + 1 - F.array_position(backwards, w))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    start_of = lambda i: total(F.slice(between, 1, i)) + total(F.slice(found, 1, i - 1))
    first, second = start_of(F.array_min(lasts).cast("int")), start_of(stop)
    before = F.length(F.substring_index(F.substring(body, F.lit(1), first), "\n", -1))
    after = F.length(F.substring_index(F.substring(body, second + 1, F.length(body)), "\n", 1))
    return F.when(F.size(found) > 0, F.substring(body, first - before + 1, second + after - first + before))


def with_snippets(results: DataFrame, docs: DataFrame, words: list[str]) -> DataFrame:
    """``results`` (``rank, doc_id, url, score``) with the snippet of each document; only their bodies are read.

    The results, a few rows, are kept as a table, as they are used twice.
    """
    results = materialize(results, "results")
    bodies = docs.select("doc_id", "body").join(results.select("doc_id"), "doc_id", "left_semi")
    texts = bodies.select("doc_id", snippet(F.col("body"), words).alias("snippet"))
    return results.join(texts, "doc_id", "left").select("rank", "doc_id", "url", "score", "snippet").orderBy("rank")
