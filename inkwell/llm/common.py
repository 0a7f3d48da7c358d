"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_of(trec_line: DataFrame) -> DataFrame:
    """Body lines, one row per (doc_id, line_no); rows delivered twice are one line.

    Rows without page or line number are dropped; should two deliveries
    differ, the larger text that is not null counts.
    """
    return (
        trec_line.where("doc_id IS NOT NULL AND line_no IS NOT NULL")
        .groupBy("doc_id", "line_no")
        .agg(F.max("line").alias("line"))
    )


def digest(text: Column, *, names: tuple[str, str] = ("k1", "k2")) -> list[Column]:
    """128 bits of a text as two BIGINT columns; equal texts have equal digests."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(977), text, F.length(text)).alias(names[1])]
