"""Keyword search: conjunctive and disjunctive, ranked by BM25, one query or a table of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import bm25, text
from inkwell.operators.index import Index

MOST_WORDS = 10
TOP = 10
DIGITS = 6
#: Modes: ``c`` (all words) and ``d`` (any word).
MODES = ("c", "d")


def check(query: str, mode: str) -> list[str]:
    """The words of a query; an error for more than ten words or an unknown mode."""
    mode = (mode or "").strip().lower()
    if mode not in MODES:
        raise ValueError("mode must be c (conjunctive) or d (disjunctive)")
    words = [w for w in (query or "").lower().split(" ") if w]
    if len(words) > MOST_WORDS:
        raise ValueError(f"a query has at most {MOST_WORDS} words")
    return words


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, mode, term, times, n_words`` of ``query_id, query, mode``; a word given twice counts twice."""
    words = text.query_words(F.col("query"))
    each = queries.select("query_id", F.lower(F.trim("mode")).alias("mode"), F.size(words).alias("n_words"), F.explode(words).alias("term"))
    return each.groupBy("query_id", "mode", "n_words", "term").agg(F.count(F.lit(1)).alias("times"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` of every matching document.

    Words that no document has are dropped from disjunctive queries and leave
    conjunctive ones without a result.  Queries of more than ten words or of
    an unknown mode are an error.
    """
    bad = ~F.col("mode").isin(*MODES) | F.col("mode").isNull()
    terms = query_terms(queries).withColumn("n_words", F.when(bad, F.raise_error(F.lit("unknown mode")).cast("int"))
                                            .when(F.col("n_words") > MOST_WORDS, F.raise_error(F.lit(f"a query has at most {MOST_WORDS} words")).cast("int"))
                                            .otherwise(F.col("n_words")))
    bound = terms.join(index.lexicon, "term")
    n_docs, avg_len = index.stats.select("n_docs").scalar(), index.stats.select("avg_len").scalar()
    one = bm25.term_score(F.col("tf"), F.col("df"), F.col("doc_len"), n_docs, avg_len)
    matched = index.postings.select("term", "doc_id", "tf").join(bound, "term").join(index.page_table.select("doc_id", "doc_len"), "doc_id")
    summed = matched.groupBy("query_id", "mode", "n_words", "doc_id").agg(
        F.sum(one * F.col("times")).alias("raw"), F.sum("times").alias("found"))
    whole = (F.col("mode") == "d") | (F.col("found") == F.col("n_words"))
    return summed.where(whole).select("query_id", "doc_id", F.round("raw", DIGITS).alias("score"))


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The best ``k`` documents of each query: ``query_id, rank, doc_id, score``; ties go to the smaller doc id.

    Spark keeps the best ``k`` per query in every task before the exchange,
    so a query that matches everything doesn't sort in one task.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search(index: Index, query: str, mode: str = "d", k: int = TOP) -> DataFrame:
    """``rank, doc_id, url, score`` of one query, best first; no rows where nothing matches."""
    words = check(query, mode)
    spark = index.postings.sparkSession
    queries = spark.createDataFrame([(0, " ".join(words), mode.strip().lower())], "query_id int, query string, mode string")
    # a filter on the words reaches the scan of a saved index (row groups sorted by term) or the tokens of a lazy one
    only = F.col("term").isin(words) if words else F.lit(False)
    narrow = replace(index, postings=index.postings.where(only), lexicon=index.lexicon.where(only))
    best = top(scores(narrow, queries), k)
    return best.join(index.page_table.select("doc_id", "url"), "doc_id", "left").select("rank", "doc_id", "url", "score").orderBy("rank")


def matching_documents(index: Index, words: list[str], mode: str) -> DataFrame:
    """``doc_id`` of documents that hold all (``c``) or any (``d``) of the words, unranked."""
    wanted = sorted({w.lower() for w in words if w})
    hits = index.postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") >= (len(wanted) if mode == "c" else 1)).where(F.lit(bool(wanted))).select("doc_id")


#: What becomes of a query.
ANSWERED, TOO_LONG, NO_MODE, NOTHING, INCOMPLETE = "answered", "too many words", "unknown mode", "no word found", "some words missing"


def states(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, state``: whether a query can be answered, and if not why, before anything is searched.

    In turn: more than ten words, a mode that isn't known, no word that any
    document has (also a query without words), or, of a conjunctive query,
    some word that none has.  Only the lexicon is read.
    """
    words = text.query_words(F.col("query"))
    each = queries.select("query_id", F.lower(F.trim("mode")).alias("mode"), F.size(words).alias("n_words"), F.explode_outer(F.array_distinct(words)).alias("term"))
    known = index.lexicon.select("term", F.lit(1).alias("known"))
    met = each.join(known, "term", "left").groupBy("query_id").agg(
        F.first("mode").alias("mode"), F.first("n_words").alias("n_words"), F.count("term").alias("terms"), F.count("known").alias("known"))
    state = (
        F.when(F.col("n_words") > MOST_WORDS, TOO_LONG).when(F.coalesce(~F.col("mode").isin(*MODES), F.lit(True)), NO_MODE)
        .when(F.col("known") == 0, NOTHING).when((F.col("mode") == "c") & (F.col("known") < F.col("terms")), INCOMPLETE).otherwise(ANSWERED)
    )
    return met.select("query_id", state.alias("state"))
