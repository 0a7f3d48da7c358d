"""How often every term occurs, in how many pages, and which terms are of no use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE_PAGES = 2
COMMON_SHARE = 0.25


def term_counts(entries: DataFrame) -> DataFrame:
    """``word, n_pages, occurrences`` of valid entries (one per word and page).

    Each task folds its (word, page) rows by hash to one row per word before
    the exchange, so a word of most pages sends one row per task.
    """
    return entries.groupBy("word").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("occurrence").alias("occurrences"))


def page_count(entries: DataFrame) -> DataFrame:
    """One row ``n``: pages with a valid entry."""
    return entries.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))


def marked_terms(entries: DataFrame, rare_pages: int = RARE_PAGES, common_share: float = COMMON_SHARE) -> DataFrame:
    """``word, n_pages, occurrences, marks``: the counts with an array of the marks that hold.

    ``rare``: at most ``rare_pages`` pages.  ``common``: in more than
    ``common_share`` of all pages with a valid entry.  In a tiny collection a
    word can be both.  No entries give no rows.
    """
    rare = F.when(F.col("n_pages") <= rare_pages, F.lit("rare"))
    common = F.when(F.col("n_pages") > F.lit(common_share) * page_count(entries).scalar(), F.lit("common"))
    return term_counts(entries).withColumn("marks", F.array_compact(F.array(rare, common)))
