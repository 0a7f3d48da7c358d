"""The graph of links between documents of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL_PATTERN = r"https?://[^\s<>\"']+"
#: A piece of text that is an address without scheme, after opening brackets: a host with a top-level name, maybe port, path, query.
BARE_PATTERN = r"^[(\[{]*((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::[0-9]+)?(?:[/?#].*)?)$"


def urls_in(text: Column) -> Column:
    """Different addresses in a text, as they stand there: ``http(s)://…`` anywhere, and pieces that are addresses without scheme.

    An address ends at white space, an angle bracket or a quotation mark; one
    without scheme also loses closing brackets and punctuation at its end.
    Linear in the text: pieces are looked at once, from their start.
    """
    pieces = F.transform(F.split(text, r"[\s<>\"']+"), lambda t: F.regexp_extract(F.regexp_replace(t, r"[.,;:!?)\]}]+$", ""), BARE_PATTERN, 1))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)), F.filter(pieces, lambda t: t != "")))


def normalized_url(url: Column) -> Column:
    """An address with its scheme (``http`` where it has none) and host in lower case, and with the path ``/`` where it has none."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    rest = F.when(scheme != "", F.substring(url, F.length(scheme) + 4, F.length(url))).otherwise(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.concat(F.when(scheme != "", F.lower(scheme)).otherwise(F.lit("http")), F.lit("://"), F.lower(host),
                    F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)))


def url_dictionary(docs: DataFrame) -> DataFrame:
    """``url, doc_id``: of documents with one url the last counts; null urls have no row."""
    return docs.where("url IS NOT NULL").groupBy("url").agg(F.max("doc_id").alias("doc_id"))


def edges(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """``src, dst``, each once: links of ``mentions`` (``doc_id, text``) whose address, as it stands or normalized, is a document's url.

    A document's links to itself stay.  Targets that are no documents are pruned.
    """
    each = mentions.select(F.col("doc_id").alias("src"), F.explode(urls_in(F.col("text"))).alias("url"))
    found = each.select("src", F.explode(F.array_distinct(F.array("url", normalized_url(F.col("url"))))).alias("url")).distinct()
    linked = found.join(url_dictionary(docs).withColumnRenamed("doc_id", "dst"), "url").select("src", "dst").distinct()
    return linked.join(docs.select(F.col("doc_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
