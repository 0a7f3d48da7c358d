"""The Parquet tables of a data folder, read by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.shipping import ship


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; a file or a folder of part files."""
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer than half as many tasks.

    A small table in one row group would be worked on by one core, whatever
    the work per row.  Tables of more files than that stay as they are, so
    nothing large is exchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def site_of(url: Column) -> Column:
    """Host of a url: outer spaces, scheme, port and a leading ``www.`` dropped, lower case; null if none is left."""
    host = F.lower(F.trim(url))
    host = F.regexp_replace(host, r"^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(host, r"[/?#].*$", "")
    host = F.regexp_replace(host, r":[0-9]*$", "")
    host = F.trim(F.regexp_replace(host, r"^www\.", ""))
    return F.when(host != "", host)


def page_rows(page_table: DataFrame) -> DataFrame:
    """One row per ``doc_id``: the one fetched last (ties: the largest values), with its ``site``.

    Rows without ``doc_id`` are dropped; a null ``fetched_at`` is older than any time.
    """
    newest = F.max(F.struct("fetched_at", "word_number", "url")).alias("row")
    return (
        page_table.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(newest)
        .select("doc_id", F.col("row.url").alias("url"), F.col("row.word_number").alias("word_number"),
                F.col("row.fetched_at").alias("fetched_at"), site_of(F.col("row.url")).alias("site"))
    )


def entries(list_pointer: DataFrame) -> DataFrame:
    """The valid inverted-list entries, one per (word, doc_id): the latest load counts.

    A row is valid if its word is not null or blank, its page is not null and
    its occurrence is above 0; words are compared trimmed and in lower case.
    Loads of one time are ordered by occurrence.
    """
    word = F.lower(F.trim("word"))
    # time and occurrence in one number, so that the rows are folded by hash; a struct's maximum would sort them
    time = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(1 << 63)))
    packed = time.cast("decimal(19,0)") * F.lit(_STEP).cast("decimal(11,0)") + F.col("occurrence").cast("decimal(10,0)")
    return (
        list_pointer.select(word.alias("word"), "doc_id", "occurrence", "loaded_at")
        .where("word <> '' AND doc_id IS NOT NULL AND occurrence > 0")
        .groupBy("word", "doc_id")
        .agg(F.max(packed).alias("latest"))
        .select("word", "doc_id", F.pmod("latest", F.lit(_STEP).cast("decimal(11,0)")).cast("int").alias("occurrence"))
    )


_STEP = 10_000_000_000  # above any occurrence
